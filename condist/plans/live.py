"""Streaming queries: the tables read as streams, to the end of what is there."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.functions.shared import shared_folder
from condist.functions.times import DAY, micros
from condist.operators import scoring
from condist.plans import alerts, core
from condist.plans import views as v
from condist.plans.registry import query
from condist.sources import metrics
from condist.streaming import conditions, jobs

E = SparkSession


def stream(spark: E, d: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    # as a pattern, for a stream takes a single file only by pattern
    return spark.readStream.schema(schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def observations(spark: E, d: str) -> DataFrame:
    rows = stream(spark, d, "events")
    return rows.select("event_id", F.col("event_type").alias("service"), "user_id", F.timestamp_micros(micros("ts")).alias("ts"), "value")


CLOSED = "w <= (SELECT max(us) - 1 - 86400000000 FROM obs)"


@query(f"SELECT service, w, round(v, 9) AS v, c FROM ys WHERE {CLOSED}")
def stream_chunks(spark: E, d: str) -> DataFrame:
    """Samples of all windows that the watermark has closed."""
    out = jobs.finished(jobs.chunks(observations(spark, d), "6 hours"), spark, "chunks")
    return out.withColumn("v", F.round("v", 9))


@query("SELECT DISTINCT event_id // 2 AS key, event_type AS service FROM events")
def stream_dedup(spark: E, d: str) -> DataFrame:
    """Events whose key was not seen before (two neighbours share a key if they are of one type)."""
    rows = observations(spark, d).withColumn("key", F.expr("event_id div 2"))
    return jobs.finished(jobs.deduplicated(rows, ["key", "service"]).select("key", "service"), spark, "dedup")


@query("SELECT id, service, generation FROM (SELECT o_orderkey AS id, o_orderpriority AS service, 1 + (o_orderkey // 8) % 2 AS generation FROM orders) WHERE generation = CASE WHEN service < '3' THEN 1 ELSE 2 END")
def stream_generation(spark: E, d: str) -> DataFrame:
    """Chunk writes of the active generations; those of an old configuration are rejected."""
    rows = stream(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("service"), F.expr("1 + (o_orderkey div 8) % 2").alias("generation"))
    return jobs.finished(jobs.current_generation(rows, v.monitored(spark, d)), spark, "generation").select("id", "service", "generation")


@query(
    """SELECT service, w, CAST((us // 1000000) - ((us // 1000000) % 60) AS DOUBLE) AS ts_s, round(max(value), 9) AS value
FROM win WHERE ((us // 1000000) - ((us // 1000000) % 60)) * 1000000 > w - 21600000000 GROUP BY ALL"""
)
def stream_responses(spark: E, d: str) -> DataFrame:
    """Exported responses as a stream of files."""
    found = metrics.exports(spark, core.exported(spark, d), "service string", stream=True)
    return jobs.finished(core.loaded(found), spark, "responses")


#: Moments between which the events arrive, in ten deliveries of three days.
ARRIVALS = [1_704_067_200_000_000 + k * 3 * DAY for k in range(11)]


def delivered(rows: DataFrame, us: str, moments: list[int], path: str) -> Iterator[None]:
    """Write rows (with microseconds ``us``) in order of time, those between two moments together; the first and last are open.

    Yields after each delivery, for a job to take it. A delivery of a large
    table has many files, none of them before another in time, so it is one
    batch only if the job takes all that is there.
    """
    for k, (a, b) in enumerate(zip(moments, moments[1:], strict=False)):
        low, high = (F.lit(True) if k == 0 else F.col(us) > a), (F.lit(True) if k == len(moments) - 2 else F.col(us) <= b)
        rows.where(low & high).write.mode("append").parquet(path)
        yield


def arrivals(spark: E, d: str) -> DataFrame:
    rows = v.table(spark, d, "events")
    return rows.select("event_id", F.col("event_type").alias("service"), F.timestamp_micros(micros("ts")).alias("ts"), "value", micros("ts").alias("us"))


ARRIVAL = "event_id long, service string, ts timestamp, value double, us long"


@query(f"SELECT service, w, round(v, 9) AS v, c FROM ys WHERE {CLOSED}")
def stream_restart(spark: E, d: str) -> DataFrame:
    """Samples of closed windows by a job that stops after each of ten deliveries, one a micro-batch, and is started again for the next."""
    folder, path = shared_folder(spark, "restart"), shared_folder(spark, "arrivals")
    for _ in delivered(arrivals(spark, d), "us", ARRIVALS, path):
        out = jobs.finished(jobs.chunks(jobs.files(spark, ARRIVAL, path), "6 hours"), spark, "chunks", folder=folder)
    return out.withColumn("v", F.round("v", 9))


def late_run(spark: E, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored arrivals, the closed chunks of a stream, and the windows short of observations; every tenth observation was delivered when the job had taken all others."""
    folder, path, rows = shared_folder(spark, "late"), shared_folder(spark, "arrivals"), arrivals(spark, d)
    late = delivered(rows.where("event_id % 10 = 0"), "us", [ARRIVALS[0], ARRIVALS[-1]], path)
    for _ in chain(delivered(rows.where("event_id % 10 <> 0"), "us", ARRIVALS, path), late):
        closed = jobs.finished(jobs.chunks(jobs.files(spark, ARRIVAL, path), "6 hours"), spark, "chunks", folder=folder)
    stored = spark.read.schema(ARRIVAL).parquet(path)
    clock = stored.agg(F.max("us")).first()[0] - 1
    return stored, closed, jobs.recovered(stored, closed, v.WINDOW, clock)


# the watermark stands a microsecond and a day behind the latest on-time observation when the late ones come
CLOCK = "(SELECT max(us) - 1 FROM obs)"
ON_TIME = "(SELECT max(us) - 1 - 86400000000 FROM obs WHERE event_id % 10 <> 0)"
SHORT = f"""SELECT service, w, count(*) FILTER (event_id % 10 = 0) AS late, CASE WHEN w + 172800000000 > {CLOCK} THEN 'recovered' ELSE 'gap' END AS state
FROM win WHERE w <= {ON_TIME} AND w + 86400000000 <= {CLOCK} GROUP BY service, w HAVING count(*) FILTER (event_id % 10 = 0) > 0"""


@query(f"SELECT service, w, late, state, true AS historical FROM ({SHORT})")
def stream_recovery(spark: E, d: str) -> DataFrame:
    """Windows short of observations after a stream whose last delivery came behind the watermark."""
    return late_run(spark, d)[2]


@query(
    f"""SELECT y.service, y.w, round(y.value, 9) AS v, count(*) AS c, coalesce(s.state = 'recovered', false) AS historical
FROM win y LEFT JOIN ({SHORT}) s ON s.service = y.service AND s.w = y.w
WHERE y.w <= {CLOCK} - 86400000000 AND (y.event_id % 10 <> 0 OR y.w > {ON_TIME} OR s.state = 'recovered') GROUP BY 1, 2, y.value, 5"""
)
def stream_rewritten(spark: E, d: str) -> DataFrame:
    """Chunks after recovery: those of the last day are made again with what came late, older ones keep their gap."""
    stored, closed, found = late_run(spark, d)
    return jobs.rewritten(stored, closed, found, v.WINDOW).withColumn("v", F.round("v", 9))


@query(f"SELECT service, w, level, round(p, 9) AS p, state FROM analysis WHERE {CLOSED}")
def stream_scoring(spark: E, d: str) -> DataFrame:
    """Verdicts of the closed windows after the reference."""
    mass = v.published(spark, d)
    samples = jobs.chunks(observations(spark, d), "6 hours").where(F.col("w") > v.TRAIN_US)
    out = jobs.scored(samples, spark, lambda x, y: scoring.analyse(x, y, mass, v.MODEL))
    return out.select("service", "w", "level", F.round("p", 9).alias("p"), "state")


@query(
    """SELECT service, indicator, alert, n AS occurrences, CASE WHEN n >= 3 THEN 'critical' ELSE 'warning' END AS severity, 'firing' AS status, us FROM hits
UNION ALL SELECT service, indicator, alert, occurrences, severity, status, resolved_us FROM anomalies WHERE status = 'resolved'"""
)
def stream_alerts(spark: E, d: str) -> DataFrame:
    """Updates of anomaly conditions from live verdicts, in ten deliveries by a job that stops after each and is started again."""
    rows = v.verdicts(spark, d).where(~F.col("historical"))
    out = fed(spark, alerts.events_of(rows, F.col("state") == "bad", F.col("state") == "good", F.lit("good_chunk")))
    return out.select("service", "indicator", "alert", "occurrences", "severity", "status", "us")


#: Ends of ten deliveries of the orders, from 1992 to 1998.
ORDERED = [694_224_000_000_000 + k * 241 * DAY for k in range(11)]
EVENT = "service string, indicator int, us long, id long, occurs boolean, ends boolean, reason string"


def fed(spark: E, events: DataFrame) -> DataFrame:
    """Updates of conditions by events in ten deliveries, each taken by a run of its own."""
    folder, path = shared_folder(spark, "alert-job"), shared_folder(spark, "events")
    for _ in delivered(events.select(*conditions.EVENTS), "us", ORDERED, path):
        out = conditions.alert_stream(jobs.files(spark, EVENT, path), spark, refresh_us=0, folder=folder)
    return out


@query(
    f"""SELECT service, indicator, alert, n AS occurrences, CASE WHEN n >= 3 THEN 'critical' ELSE 'warning' END AS severity, 'firing' AS status, CAST(NULL AS VARCHAR) AS reason, us FROM (
  SELECT *, row_number() OVER (PARTITION BY service, indicator, island ORDER BY us, id) AS n, first_value(id) OVER (PARTITION BY service, indicator, island ORDER BY us, id) AS alert
  FROM (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY service, indicator ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM ({alerts.CLOSE}))
  WHERE occurs)
UNION ALL SELECT service, indicator, alert, occurrences, severity, status, reason, resolved_us FROM ({alerts.conditions_sql(alerts.CLOSE, "service, indicator")}) WHERE status = 'resolved'"""
)
def stream_closeout(spark: E, d: str) -> DataFrame:
    """The same where a pause, a removal or a change of generation closes a key's condition and drops its state."""
    s, close = F.col("state"), F.expr("id % 17 = 0")
    rows = v.verdicts(spark, d).where(~F.col("historical"))
    events = alerts.events_of(rows, (s == "bad") & ~close, (s == "good") | close, F.when(close, F.expr(alerts.CLOSING)).otherwise("good_chunk"))
    return fed(spark, events).select("service", "indicator", "alert", "occurrences", "severity", "status", "reason", "us")
