"""The stored chunk table: merges equal the latest-wins result, and a point read opens only its partitions."""

import random

import pytest
from pyspark.sql import functions as F

from condist.functions.shared import shared_folder
from condist.functions.times import DAY
from condist.operators import store

KEYS = ["service", "w"]
WRITE = "service string, w long, generation long, collected_at long, id long, body double"
VERDICT = "service string, w long, generation long, state string, p double, analysed_at long"


def test_rounds_equal_a_plain_table(spark):
    draw, path = random.Random(6), shared_folder(spark, "store")
    plain = {}
    for number in range(3):
        writes = [(draw.choice("ab"), draw.randint(1, 6) * DAY // 2, draw.randint(0, 2), draw.randint(0, 50), number * 100 + i, draw.random()) for i in range(15)]
        store.write_chunks(spark, path, spark.createDataFrame(writes, WRITE), KEYS)
        for w in sorted(writes, key=lambda w: w[2:5]):
            old = plain.get(w[:2])
            if old is None or list(w[2:5]) > old[:3]:
                same = old is not None and old[0] == w[2]
                plain[w[:2]] = [*w[2:], *(old[4:] if same else ["pending", None])]
        judged = [(k[0], k[1], draw.randint(0, 2), draw.choice(["good", "bad"]), draw.random(), number) for k in plain]
        store.write_verdicts(spark, path, store.table(spark, path), spark.createDataFrame(judged, VERDICT), KEYS)
        for service, w, generation, state, p, _ in judged:
            if plain[service, w][0] == generation:
                plain[service, w][4:] = [state, p]
        got = {(r.service, r.w): [r.generation, r.collected_at, r.id, r.body, r.state, r.p] for r in store.table(spark, path).collect()}
        assert got == plain


def test_a_newer_generation_clears_verdict_and_review(spark):
    path = shared_folder(spark, "store")
    write = lambda generation, id_: store.write_chunks(spark, path, spark.createDataFrame([("a", DAY, generation, id_, id_, 1.0 * id_)], WRITE), KEYS)
    write(1, 1)
    store.write_verdicts(spark, path, store.table(spark, path), spark.createDataFrame([("a", DAY, 1, "bad", 0.001, 5)], VERDICT), KEYS)
    store._replace(store.table(spark, path).withColumn("review_override", F.lit(True)), path)
    write(1, 2)  # the same generation: the body is replaced, verdict and review stay
    assert [(r.body, r.state, r.review_override) for r in store.table(spark, path).collect()] == [(2.0, "bad", True)]
    write(2, 3)
    assert [(r.body, r.state, r.p, r.review_override) for r in store.table(spark, path).collect()] == [(3.0, "pending", None, None)]
    write(1, 9)  # of an older one: rejected
    assert [(r.generation, r.body) for r in store.table(spark, path).collect()] == [(2, 3.0)]


def test_point_reads_open_one_partition(spark):
    path = shared_folder(spark, "store")
    rows = [(s, d * DAY, 1, d, d, float(d)) for s in ("a", "b") for d in range(1, 21)]
    store.write_chunks(spark, path, spark.createDataFrame(rows, WRITE), KEYS)
    wanted = spark.createDataFrame([("a", 3 * DAY)], "service string, w long")
    out = store.read_chunks(spark, path, wanted, KEYS)
    assert [(r.w, r.body) for r in out.collect()] == [(3 * DAY, 3.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    opened = store.touched(store.table(spark, path), wanted.withColumn("day", store.day()))
    opened.collect()
    assert opened.select(F.input_file_name()).distinct().count() == 1
    with pytest.raises(Exception, match="no chunk of b"):
        store.read_chunks(spark, path, spark.createDataFrame([("b", 99 * DAY)], "service string, w long"), KEYS).collect()


def test_writes_leave_other_partitions_alone(spark):
    path = shared_folder(spark, "store")
    store.write_chunks(spark, path, spark.createDataFrame([("a", DAY, 1, 1, 1, 1.0), ("a", 2 * DAY, 1, 1, 2, 1.0)], WRITE), KEYS)
    files = lambda day: {r[0] for r in store.table(spark, path).where(f"day = {day}").select(F.input_file_name()).collect()}
    before = files(0), files(1)
    store.write_chunks(spark, path, spark.createDataFrame([("a", 2 * DAY, 1, 2, 3, 2.0)], WRITE), KEYS)
    assert files(0) == before[0] and files(1) != before[1]
