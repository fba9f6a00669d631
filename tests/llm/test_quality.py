import zlib

import numpy as np
import pyarrow as pa

from condist.llm import quality


def test_statistics_against_plain_counting():
    texts = ["", None, "a a A b", "One line.\nOne line.\nTwo!! | ###", "É é ÀB", "x" * 5000, " lead\n\n\ttail "]
    got = quality.statistics(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        t = t or ""
        n, w = max(len(t), 1), t.replace("É", "é").replace("À", "à").split()
        at = dict(zip(quality.NAMES, row, strict=True))
        low = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in t.split()]
        assert np.isclose(at["pipe"], t.count("|") / n) and np.isclose(at["upper"], sum(c.isascii() and c.isupper() for c in t) / n)
        assert np.isclose(at["repeats"], sum(a == b for a, b in zip(low, low[1:], strict=False)) / max(len(w), 1))
        assert np.isclose(at["distinct"], np.log1p(len(set(low))) / np.log1p(max(len(w), 1)) if w else 0)
        assert np.isclose(at["words"], np.log1p(len(w)) / 10)
        lines = [x for x in t.lower().split("\n") if x]
        assert np.isclose(at["same_lines"], (len(lines) - len(set(lines))) / len(lines) if lines else 0)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 5, 8)
        k = rng.integers(0, n + 1)
        x, levels = quality.isotonic(np.arange(8.0), k, n)
        assert (np.diff(levels) > 0).all() and (np.diff(x) > 0).all()
        # the min-max formula of monotone regression
        best = [max(min(k[i : j + 1].sum() / n[i : j + 1].sum() for j in range(m, 8)) for i in range(m + 1)) for m in range(8)]
        assert np.allclose(sorted(set(np.round(best, 12))), levels)


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op2_quality(spark, d).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(rows[i].predicted, y) for i, y in truth.items() if rows[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "word " * 50000, 5), (4, "same", 6), (4, "same", 6)], "doc_id long, text string, score int")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    few = quality.fit(docs, spark.createDataFrame([(1, 0, 0), (2, 1, 0), (4, 1, None), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int"))
    rows = quality.score(docs, few).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score and rows[3].score == rows[4].score
    assert quality.score(docs.limit(0), few).collect() == []


def test_fit_against_plain_algebra(spark):
    """Weights by the closed form over all rows at once, calibration by the min-max formula."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["plain", "words", "about", "things", "and", "more."], rng.integers(5, 60))) if i % 3 else "###|!! " * int(rng.integers(3, 30)) + f"x{i % 5}" for i in range(240)]
    ones = [int((i % 3 > 0) ^ (i % 17 == 0)) for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(ones)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, dimension=32)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(240)])
    y, use = np.array(ones, float), fold != 0
    stats = quality.statistics(pa.array(texts))
    mean, scale = stats[use].mean(axis=0), stats[use].std(axis=0)
    scale[scale < 1e-6] = 1
    gen = np.random.default_rng(7)
    directions = gen.normal(0, 1 / np.sqrt(len(quality.NAMES)), (len(quality.NAMES), 32))
    phases = gen.uniform(0, 2 * np.pi, 32)
    z = np.sqrt(2 / 32) * np.cos(np.clip((stats - mean) / scale, -6, 6) @ directions + phases)
    share = (y[use].sum() + 0.5) / (use.sum() + 1)
    weight = np.where(y == 1, share / y[use].mean(), (1 - share) / (1 - y[use].mean()))
    learn, check = use & (fold != 1), fold == 1
    gram = (z[learn] * weight[learn, None]).T @ z[learn]
    solved = np.linalg.solve(gram + 1e-3 * (np.trace(gram) / 32 + 1e-9) * np.eye(32), (z[learn] * weight[learn, None]).T @ y[learn])
    assert np.allclose(model.raw(stats), z @ solved, atol=1e-6)
    cells = np.floor(np.clip(z @ solved, -1, 2) * 1000)
    at = np.unique(cells[check])
    total = np.array([weight[check & (cells == c)].sum() for c in at])
    hit = np.array([(weight * y)[check & (cells == c)].sum() for c in at])
    best = [max(min(hit[i : j + 1].sum() / total[i : j + 1].sum() for j in range(m, len(at))) for i in range(m + 1)) for m in range(len(at))]
    assert np.allclose(sorted(set(np.round(best, 9))), model.levels, atol=1e-6)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.allclose([got[i] for i in range(240)], np.clip(np.interp(z @ solved, model.knots, model.levels), 0, 1), atol=1e-5)
