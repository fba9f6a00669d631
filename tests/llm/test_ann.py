import numpy as np
import pytest
from pyspark.sql import functions as F

from condist.llm import ann


def brute(rows, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = [(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j) for j, w in good if j != i and len(w) == len(v)]
            out.setdefault(i, sorted(scored)[:k])
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, want):
    return np.mean([len({j for _, j in found.get(q, [])} & {j for _, j in w}) / max(len(w), 1) for q, w in want.items() if w])


def test_whole_table(spark):
    d = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found, want = got(ann.op6_ann(spark, d)), brute(rows)
    assert set(found) == set(want) and recall(found, want) >= 0.95
    exact = {(q, j): s for q, w in want.items() for s, j in w}
    assert all(abs(exact[q, j] - s) < 1e-12 for q, w in found.items() for s, j in w if (q, j) in exact)


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_recall_over_cells(spark, monkeypatch, spread):
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + spread * rng.normal(size=24)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = got(ann.nearest(df, F.col("vec_id") % 50 == 0)), brute(rows)
    assert recall(found, want) >= 0.9 and all(len(v) == 5 for v in found.values())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, None), (8, []), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (50, [1.0, 2.0, 3.0]), (100, [5.0, 0.0]), (100, [5.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, d int, i int")
    found = got(ann.nearest(df, F.col("vec_id") % 50 == 0))
    assert [j for _, j in found[0]] == [1, 2, 2, 100, 100] and 50 not in found
    assert [j for _, j in found[100]] == [0, 1, 2, 2, 9]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_hot_vector_ties_go_to_small_ids(spark):
    rows = [(i, [0.3, 0.7, 0.1] if i % 2 else [float(i), 1.0, 2.0]) for i in range(1, 2000)] + [(2050, [0.3, 0.7, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = got(ann.nearest(df, F.col("vec_id") == 2050))
    assert [j for _, j in found[2050]] == [1, 3, 5, 7, 9]


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-201]), (2, [0.0, 5e-324]), (3, [-1e300, 1e300]), (4, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(ann.nearest(df, F.col("vec_id") == 0))[0]
    assert [j for _, j in found] == [1, 4, 2, 3]
    assert np.allclose([-s for s, _ in found], [1 / np.sqrt(1.01), 2 / np.sqrt(5), 0.0, -np.sqrt(0.5)])
