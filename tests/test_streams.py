"""Streams that fail, stop and start again; late rows; keyed state with timers."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from condist.functions.shared import shared_folder
from condist.plans import catalog
from condist.streaming import conditions, jobs

SECOND = 1_000_000
EVENT = "service string, indicator int, us long, id long, occurs boolean, ends boolean, reason string"


def deliver(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_failed_batch_is_made_again_once(spark):
    """The sink fails after it wrote half of a batch; the job's next run replaces that and goes on."""
    path, folder = shared_folder(spark, "in"), shared_folder(spark, "job")
    for k in range(5):
        deliver(spark, [(k * 10 + i,) for i in range(10)], "id long", path)
    failures = []

    def sink(batch, out, number):
        if number == 2 and not failures:
            failures.append(number)
            batch.limit(3).write.mode("overwrite").parquet(f"{out}/batch={number}")
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = lambda: jobs.finished(jobs.files(spark, "id long", path, 1), spark, "x", sink=sink, folder=folder)
    with pytest.raises(Exception, match="lost"):
        run()
    assert failures == [2] and spark.read.parquet(f"{folder}/rows").count() == 23
    assert sorted(r.id for r in run().collect()) == list(range(50))
    deliver(spark, [(50,)], "id long", path)
    assert sorted(r.id for r in run().collect()) == list(range(51))


def test_late_rows_are_recovered_or_gaps(spark):
    hour = 3600 * SECOND
    path, folder = shared_folder(spark, "in"), shared_folder(spark, "job")
    schema = "service string, us long, value double"
    deliver(spark, [("a", h * hour - 1, float(h)) for h in range(1, 97)], schema, path)

    def run():
        rows = jobs.files(spark, schema, path).withColumn("ts", F.timestamp_micros("us"))
        return jobs.finished(jobs.chunks(rows, "1 hour"), spark, "chunks", folder=folder)

    assert run().agg(F.max("w")).first()[0] == 71 * hour
    deliver(spark, [("a", 10 * hour - 5, 7.0), ("a", 60 * hour - 5, 7.0), ("a", 90 * hour - 5, 7.0)], schema, path)
    closed, stored = run(), spark.read.schema(schema).parquet(path)
    found = jobs.recovered(stored, closed, hour, 96 * hour - 2)
    assert sorted((r.w // hour, r.late, r.state, r.historical) for r in found.collect()) == [(10, 1, "gap", True), (60, 1, "recovered", True)]
    out = jobs.rewritten(stored, closed, found, hour).collect()
    assert len(out) == 72 and sorted((r.v, r.c) for r in out if r.historical) == [(7.0, 1), (60.0, 1)] and {r.w // hour for r in out if r.historical} == {60}
    # a window that is not closed yet is no window that failed
    assert 90 not in {r.w // hour for r in found.collect()}


def plain_updates(events, threshold=3):
    state, out = {}, []
    for e in sorted(events, key=lambda e: (e[2], e[3])):
        service, indicator, us, number, occurs, ends, reason = e
        alert, count = state.get((service, indicator), (None, 0))
        severity = lambda n: "critical" if n >= threshold else "warning"
        if occurs:
            alert, count = (alert, count + 1) if count else (number, 1)
            state[service, indicator] = (alert, count)
            out.append((service, indicator, alert, count, severity(count), "firing", None, us))
        elif ends and count:
            out.append((service, indicator, alert, count, severity(count), "resolved", reason, us))
            state[service, indicator] = (None, 0)
    return out, {k: v for k, v in state.items() if v[1]}


def test_conditions_over_restarts(spark):
    draw = random.Random(4)
    kinds = [(True, False, None), (True, False, None), (False, True, "good_chunk"), (False, True, "configuration_changed"), (False, False, None)]
    events = [(draw.choice("ab"), 1, us * SECOND, us, *draw.choice(kinds)) for us in range(90)]
    path, folder = shared_folder(spark, "in"), shared_folder(spark, "job")
    for k in range(0, 90, 30):
        deliver(spark, events[k : k + 15], EVENT, path)
        deliver(spark, events[k + 15 : k + 30], EVENT, path)
        out = conditions.alert_stream(jobs.files(spark, EVENT, path, 1), spark, refresh_us=0, folder=folder)
        want, firing = plain_updates(events[: k + 30])
        got = [tuple(r[c] for c in ("service", "indicator", "alert", "occurrences", "severity", "status", "reason", "us")) for r in out.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        # what the state store holds is the firing alerts, and nothing of closed ones
        kept = {(r.service, r.indicator): (r.alert, r["count"]) for r in conditions.firing(spark, folder).collect()}
        assert kept == firing
    assert "Memory" not in str(spark.conf.get("spark.sql.streaming.stateStore.providerClass")) and len(want) > 30


def test_a_quiet_alert_is_handed_on_again(spark):
    minute = 60 * SECOND
    path, folder = shared_folder(spark, "in"), shared_folder(spark, "job")
    run = lambda: conditions.alert_stream(jobs.files(spark, EVENT, path, 1), spark, late="0 seconds", folder=folder)
    deliver(spark, [("a", 1, minute, 1, True, False, None), ("b", 1, minute, 2, True, False, None)], EVENT, path)
    deliver(spark, [("b", 1, 2 * minute, 3, False, True, "monitoring_paused")], EVENT, path)
    assert run().where("status = 'refresh'").count() == 0
    deliver(spark, [("c", 1, 20 * minute, 4, False, True, "good_chunk")], EVENT, path)
    again = run().where("status = 'refresh'").collect()
    assert {(r.service, r.alert, r.occurrences, r.us) for r in again} == {("a", 1, 1, 3 * minute)}
    assert [(r.service, r.alert) for r in conditions.firing(spark, folder).collect()] == [("a", 1)]


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """Small tables whose files are in no order of time."""
    d = str(tmp_path_factory.mktemp("spark-files"))
    for name in ("orders", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["stream_alerts", "stream_closeout", "stream_restart", "stream_rewritten"])
def test_a_delivery_of_many_files_is_one_batch(spark, many_files, name):
    con = duckdb.connect()
    for table in ("orders", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{many_files}/{table}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, many_files)
    columns = ", ".join(df.columns)
    want = con.sql(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert want and sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)
