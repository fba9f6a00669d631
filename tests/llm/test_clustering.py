"""Clusters against plain integer arithmetic."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from condist.llm import clustering
from condist.llm.clustering import OP13_SQL, Bisectors, cluster, integers, op13_clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def plain(rows, k, rounds, dims, salt=2, scale=256):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by distances to all centroids."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        for j, vs in own.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    sums = {j: sum(d for _, d, b in out if b == j) for j in range(len(c))}
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(((i, j, fits(d), fits(sums[j]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("spread", [0.5, 0.01, 3000.0])
def test_equals_plain_distances(spark, spread):
    draw = random.Random(7)
    rows = [(i, [draw.gauss(0, spread) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, list(rows[3][1])) for i in range(200)]  # a vector that many rows share
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(5)
    assert got(cluster(df, k=7, rounds=4, dims=6)) == plain(rows, 7, 4, 6)


def test_defined_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, [0.5, -0.001]), (7, [0.5, -0.001]), (7, [2.0, 1.0]), (None, [0.0, 0.0]), (8, [0.25, 0.25])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    for k in (1, 2, 4, 40):
        assert got(cluster(df, k=k, rounds=3, dims=2)) == plain(rows, k, 3, 2)
    assert cluster(df.limit(0), dims=2).collect() == []
    assert cluster(df, dims=9).collect() == []


def test_components_of_any_size(spark):
    """Huge ones go through Python's integers; distances that no long holds are null."""
    rows = [(i, [float(i % 3) * 10.0**e, -1.0 / (i + 1)]) for i, e in enumerate((0, 3, 9, 15, 30, 300) * 4)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    assert got(cluster(df, k=5, rounds=3, dims=2)) == plain(rows, 5, 3, 2)


def test_ties_favour_the_smaller_number():
    tests = Bisectors([[0, 0], [4, 0], [0, 0], [2, 2]])
    best, far = tests.nearest(np.array([[2, 0], [2, 1], [0, 0], [4, 0]]))
    assert best.tolist() == [0, 3, 0, 1] and far.tolist() == [4, 1, 0, 0]


def test_floors():
    x = np.array([[0.1, -0.1, 1e-300, -1e-300, 2.0**60, -(2.0**60) - 0.5]])
    assert integers(x, 256).tolist() == [[math.floor(Fraction(v) * 256) for v in x[0].tolist()]]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    names = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = con.execute(f"SELECT {names} FROM ({OP13_SQL})").fetchall()
    assert got(op13_clusters(spark, sf)) == sorted(want, key=str) and len(want) > 100


def test_vectors_are_not_shuffled(spark):
    df = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    plan = clustering.assigned(clustering.kept(df, 2), [[0, 0], [1, 1]], 256)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
