"""Exported responses as files: what can be used, what cannot, and histograms."""

import json

import pytest
from pyspark.sql import functions as F

from condist.operators import alerts, evidence, notify
from condist.sources import metrics


def document(status=200, kind="matrix", result=({"metric": {"app": "x"}, "values": [[0, "1"], [60, "2.5"], [120, "NaN"]]},), answer="success"):
    return json.dumps({"query": "q", "start": "1970-01-01T00:00:00Z", "end": "1970-01-01T00:02:00Z", "step_seconds": 60, "status_code": status, "response_body": {"status": answer, "data": {"resultType": kind, "result": list(result)}}})


@pytest.fixture
def folder(tmp_path):
    lines = {
        "a": [document(), document(status=503), "{broken", document(kind="vector"), document(answer="error")],
        "b": [document(result=()), document(result=({"metric": {}, "values": []}, {"metric": {}, "values": []})), "", document()[:-30]],
    }
    for service, texts in lines.items():
        (tmp_path / f"service={service}").mkdir()
        (tmp_path / f"service={service}" / "part.json").write_text("\n".join(texts) + "\n")
    return str(tmp_path)


def test_documents_that_cannot_be_used_are_set_apart(spark, folder):
    found = metrics.exports(spark, folder, "service string")
    got = sorted((r.service, r.problem or "") for r in found.select("service", "problem").collect())
    assert got == [("a", ""), ("a", "expected a matrix, got vector"), ("a", "not JSON"), ("a", "query failed"), ("a", "status 503"), ("b", "no data"), ("b", "not JSON"), ("b", "several series")]
    points = metrics.range_matrix(found.where("problem is null").drop("problem"))
    assert [(r.service, r.start_us, r.end_us, r.ts_s, str(r.value)) for r in points.orderBy("ts_s").collect()] == [("a", 0, 120_000_000, t, x) for t, x in ((0.0, "1.0"), (60.0, "2.5"), (120.0, "nan"))]


def test_only_the_wanted_folder_is_read(spark, folder):
    found = metrics.exports(spark, folder, "service string").where("service = 'b'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(service" in plan and found.count() == 3


def test_histograms_of_a_response(spark, tmp_path):
    rows = [[1, {"count": "10", "sum": "5", "buckets": [[0, "0", "1", "10"], [0, "1", "+Inf", "2.5"]]}], [2, {"count": "13", "sum": "8", "buckets": [[0, "0", "1", "13"]]}], [3, {"count": "0", "sum": "0"}]]
    (tmp_path / "one.json").write_text(document(result=({"metric": {}, "histograms": rows},)))
    found = metrics.exports(spark, str(tmp_path)).where("problem is null").select("response")
    got = sorted((r.ts_s, r.upper, r["count"]) for r in metrics.histogram_points(found).collect())
    assert got == [(1.0, 1.0, 10), (1.0, float("inf"), 3), (2.0, 1.0, 13)]
    (tmp_path / "bad.json").write_text(document(result=({"metric": {}, "histograms": [[1, {"buckets": [[0, "0", "NaN", "1"]]}]]},)))
    with pytest.raises(Exception, match="not a number"):
        metrics.histogram_points(metrics.exports(spark, str(tmp_path)).select("response")).collect()


def test_resolutions_follow_what_was_delivered(spark):
    rows = [
        (1, 1, "firing", "delivered", "warning", "w1"),
        (1, 2, "firing", "delivered", "warning", "w2"),
        (1, 3, "firing", "pending", "critical", "c3"),
        (2, 1, "firing", "delivered", "critical", "c1"),
        (3, 1, "firing", "missed", "warning", "m"),
    ]
    df = spark.createDataFrame(rows, "alert long, n int, operation string, state string, severity string, payload string")
    ended = spark.createDataFrame([(1, 70), (3, 80)], "alert long, ended_us long")
    assert [tuple(r) for r in notify.resolutions(df, ended, ["n"]).collect()] == [(1, "resolved", "warning", "w2", 70)]


def test_texts(spark):
    row = spark.createDataFrame([(60_000_000, "api", 3, None)], "us long, service string, n long, none long").select(
        alerts.collection_text(F.col("service"), F.col("n"), "us").alias("a"), alerts.collection_text(F.col("service"), F.col("n"), "none").alias("b"),
        alerts.summary(F.lit(1), "us").alias("c"), alerts.impact(F.lit(2), F.lit(True)).alias("d"), alerts.impact(F.lit(3), F.lit(False)).alias("e"),
    ).first()
    assert "3 consecutive" in row.a and row.a.endswith("1970-01-01T00:01:00Z.") and row.b.endswith("failed.")
    assert row.c.endswith(" at 1970-01-01T00:01:00Z") and "past" in row.d and "reference" in row.e


def test_evidence_of_live_occurrences(spark):
    """Trailing chunks of one generation are merged; another generation, a deleted chunk or no model is gone; historical ones have none."""
    minute = 60_000_000
    chunk = "service string, indicator int, w long, x double, generation long"
    chunks = [("a", 2, m * minute, float(m), 1 + (m > 7)) for m in range(1, 11)] + [("b", 1, 10 * minute, 5.0, 1), ("c", 1, 10 * minute, 5.0, 1)]
    samples = [("a", 2, m * minute, v, 1) for m in range(1, 11) for v in (1.0, float(m))] + [("b", 1, 10 * minute, 9.0, 4), ("c", 1, 10 * minute, 9.0, 4)]
    occurrences = [("a", 2, 7 * minute, 0.001, False), ("a", 2, 10 * minute, 0.002, False), ("a", 2, 5 * minute, 0.003, True), ("b", 1, 10 * minute, 0.004, False), ("c", 1, 10 * minute, 0.005, False), ("d", 1, 1, 0.006, False)]
    mass = [("a", 2, 1, 2.0, 1.0, 1), ("a", 2, 1, 2.0, 2.0, 1), ("a", 2, 1, 9.0, 2.0, 1), ("b", 1, 1, 7.0, 1.0, 1)]
    out = evidence.behind(
        spark.createDataFrame(occurrences, "service string, indicator int, w long, p double, historical boolean"),
        spark.createDataFrame(chunks, chunk),
        spark.createDataFrame(samples, "service string, indicator int, w long, v double, c long"),
        spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "service string, generation long"),
        spark.createDataFrame(mass, "service string, indicator int, generation long, x double, v double, n long"),
        {2: 5 * minute},
    )
    got = {(r.service, r.w // minute): (r.status, r.chunks, r.x, r.entries, r.total, r.level, r.points) for r in out.collect()}
    gone = ("gone", None, None, None, None, None, None)
    # minutes 2 to 7: the value 1 six times, and each of 2 to 7
    assert got == {("a", 7): ("available", 6, 4.5, 7, 12, 2.0, 2), ("a", 10): gone, ("b", 10): ("available", 1, 5.0, 1, 4, 7.0, 1), ("c", 10): gone, ("d", 0): gone}
