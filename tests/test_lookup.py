"""Lookups and running sums over keys that are dealt by ranges of value, against plain code."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from condist.functions import lookup
from condist.operators import model


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def knots():
    draw = random.Random(1)
    hot = sorted({round(draw.random() * 50, 1) for _ in range(300)})
    return [("hot", v, i / len(hot)) for i, v in enumerate(hot)] + [("small", 1.0, 0.5), ("small", 2.0, 1.0)]


@pytest.fixture(scope="module")
def probes():
    draw = random.Random(2)
    return [("hot", round(draw.random() * 60 - 5, 1), i) for i in range(500)] + [("small", v, 1000 + i) for i, v in enumerate((0.0, 1.0, 1.5, 2.0, 3.0))] + [("none", 1.0, 2000)]


@pytest.mark.parametrize("part_rows", [10_000, 100, 7])
def test_neighbours(spark, knots, probes, part_rows):
    out = lookup.neighbours(table(spark, probes, "k string, v double, i int"), table(spark, knots, "k string, v double, p double"), ["k"], "v", "p", part_rows)
    got = {r.i: (r.lo_at, r.lo_value, r.hi_at, r.hi_value) for r in out.collect()}
    assert len(got) == len(probes)
    for k, v, i in probes:
        own = [(x, p) for kk, x, p in knots if kk == k]
        at = bisect.bisect_left([x for x, _ in own], v)
        assert got[i] == ((*own[at - 1],) if at else (None, None)) + ((*own[at],) if at < len(own) else (None, None))


@pytest.mark.parametrize("part_rows", [10_000, 7])
def test_at_or_below(spark, knots, probes, part_rows):
    out = lookup.at_or_below(table(spark, probes, "k string, v double, i int"), table(spark, knots, "k string, v double, p double"), ["k"], "v", "l", part_rows, also=["p"])
    got = {r.i: (r.l, r.p) for r in out.collect()}
    for k, v, i in probes:
        own = [(x, p) for kk, x, p in knots if kk == k]
        at = bisect.bisect_right([x for x, _ in own], v)
        assert got[i] == (own[max(at - 1, 0)] if own else (None, None))


@pytest.mark.parametrize("part_rows", [10_000, 7])
def test_running_sums(spark, knots, part_rows):
    df = table(spark, [(k, v, i + 1) for i, (k, v, _) in enumerate(knots)], "k string, v double, n int")
    got = {(r.k, r.v): (r._upto, r._total) for r in lookup.running(df, ["k"], "v", F.col("n"), part_rows=part_rows).collect()}
    for k in ("hot", "small"):
        own, total = sorted((v, i + 1) for i, (kk, v, _) in enumerate(knots) if kk == k), 0
        whole = sum(n for _, n in own)
        for v, n in own:
            total += n
            assert got[k, v] == (total, whole)


def test_a_large_key_is_dealt_and_a_small_one_is_not(spark, knots):
    rows, several = lookup.dealt(table(spark, knots, "k string, v double, p double"), ["k"], "v", 50)
    parts = {r.k: (r.n, r.most) for r in rows.groupBy("k", "_part").count().groupBy("k").agg(F.count("*").alias("n"), F.max("count").alias("most")).collect()}
    assert several and parts["small"] == (1, 2)
    assert parts["hot"][0] >= 4 and parts["hot"][1] <= 75
    assert lookup.dealt(table(spark, knots, "k string, v double, p double"), ["k"], "v", known=400)[1] is False


@pytest.mark.parametrize("part_rows", [10_000, 40])
def test_dominance_sums(spark, part_rows):
    draw = random.Random(5)
    mass = {}
    for _ in range(150):
        mass[draw.choice("ab"), float(draw.randint(0, 9)), float(draw.randint(0, 20))] = draw.randint(1, 5)
    asked = [(k, draw.uniform(-2, 12), draw.uniform(-2, 23)) for k in "ab" for _ in range(40)] + [(k, x, v) for k, x, v in mass] + [("c", 1.0, 1.0)]
    m = table(spark, [(*key, n) for key, n in mass.items()], "k string, x double, v double, n long")
    out = model.joint_cdf_at(m, table(spark, asked, "k string, x double, v double"), ["k"], part_rows)
    got = {(r.k, r.x, r.v): r.h for r in out.collect()}
    assert len(got) == len(set(asked)) - 1
    for k, x, v in set(asked) - {("c", 1.0, 1.0)}:
        whole = sum(n for (kk, _, _), n in mass.items() if kk == k)
        assert abs(got[k, x, v] - sum(n for (kk, a, b), n in mass.items() if kk == k and a <= x and b <= v) / whole) < 1e-12
    grid = {(r.k, r.x, r.v): r.h for r in model.joint_cdf(m, ["k"]).collect()}
    same = model.joint_cdf_at(m, spark.createDataFrame(list(grid), "k string, x double, v double"), ["k"], part_rows).collect()
    assert len(same) == len(grid) and all(abs(grid[r.k, r.x, r.v] - r.h) < 1e-12 for r in same)


def test_coalescing_reads_its_source_once(spark, tmp_path):
    near = [(1, 1.0, 0.0, 1), (1, 1.0 + 2.0**-52, 1.0, 2), (1, 4.0, 0.0, 3)]
    path = str(tmp_path / "values")
    spark.createDataFrame(near, "k int, v double, x double, n long").write.parquet(path)
    values = spark.read.parquet(path)
    out = model.coalesce_near(values, ["k"], by=("x",))
    assert sorted((r.x, r.v, r.n) for r in out.collect()) == [(0.0, 1.0, 1), (0.0, 4.0, 3), (1.0, 1.0, 2)]
    assert path not in str(out.inputFiles())  # a stored table, made in one pass over the source


def test_coalescing_of_no_rows_and_over_the_ends_of_parts(spark):
    schema = "k int, v double, x double, n long"
    assert model.coalesce_near(spark.createDataFrame([], schema), ["k"], by=("x",)).count() == 0
    end = 2.0 ** (7.63 / 16)
    run = [end + i * 2.0**-52 for i in range(-9, 10)]
    out = model.coalesce_near(table(spark, [(1, v, 0.0, 1) for v in run] + [(1, None, 0.0, 1)], schema), ["k"], by=("x",))
    assert sorted(((r.v, r.n) for r in out.collect()), key=str) == [(run[0], 19), (None, 1)]
