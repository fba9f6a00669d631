"""Queries of recovery, services and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.functions.times import DAY, HOUR
from condist.operators import alerts as a
from condist.operators import health, recovery, services
from condist.plans import views as v
from condist.plans.alerts import SI, anomaly_events
from condist.plans.registry import query

E = SparkSession
NOW = v.NOW_US
TABLES = ["service", "w"]


# --- recovery ----------------------------------------------------------------------------------------------------


@query(
    f"""SELECT service, w, count(*) AS attempts, min(us) AS first_us, max(us) AS last_us, arg_max('error ' || id, us * 10 + id % 10) AS error, min(us) + {DAY} AS expires_us,
  max(us) + 1000000 AS retry_us, 'pending' AS state
FROM attempts WHERE failed GROUP BY service, w"""
)
def backlog_upsert(spark: E, d: str) -> DataFrame:
    rows = v.attempts(spark, d).where("failed").withColumn("error", F.concat(F.lit("error "), F.col("id").cast("string")))
    return recovery.upsert(rows, TABLES, DAY)


@query("SELECT service, min(w) AS w, arg_min(attempts, w) AS attempts FROM backlog GROUP BY service")
def oldest_backlog(spark: E, d: str) -> DataFrame:
    return recovery.oldest(v.backlog(spark, d)).select("service", "w", "attempts")


CLASSIFY_NOW = NOW - 12 * HOUR


@query(
    f"""SELECT service, w, outcome, CASE WHEN outcome = 'deferred' THEN ready_us - {CLASSIFY_NOW} ELSE 0 END AS wait_us,
  CASE outcome WHEN 'gap' THEN 'expired' WHEN 'completed' THEN 'recovered' ELSE 'pending' END AS state
FROM (SELECT *, CASE WHEN expires_us <= {CLASSIFY_NOW} THEN 'gap' WHEN ready_us > {CLASSIFY_NOW} THEN 'deferred' WHEN attempts = 1 THEN 'completed' ELSE 'retry' END AS outcome
  FROM (SELECT *, last_us + 2 * {HOUR} AS ready_us FROM backlog))"""
)
def backlog_classify(spark: E, d: str) -> DataFrame:
    rows = v.backlog(spark, d).withColumn("ready_us", F.col("last_us") + 2 * HOUR).withColumn("ok", F.col("attempts") == 1)
    return recovery.classify(rows, CLASSIFY_NOW).select("service", "w", "outcome", F.col("wait_us").cast("long").alias("wait_us"), "state")


@query(
    """SELECT service, w, CAST(CASE WHEN (last_us - first_us) * 3 >= 3600000000 THEN 3600 ELSE least(pow(2, least(attempts - 1, 10)), 60) END AS BIGINT) AS delay_s FROM backlog"""
)
def recovery_delay(spark: E, d: str) -> DataFrame:
    failing = F.expr("(last_us - first_us) * 3 / 1000000")
    return v.backlog(spark, d).select("service", "w", recovery.delay_s(F.col("attempts"), failing).alias("delay_s"))


@query("SELECT id, CAST(least(pow(2, least(id % 15, 30)), interval_s, 3600) AS BIGINT) AS delay_s FROM revisions")
def interval_backoff(spark: E, d: str) -> DataFrame:
    return v.revisions(spark, d).select("id", recovery.backoff_s(F.expr("1 + id % 15"), F.col("interval_s")).alias("delay_s"))


# --- services ----------------------------------------------------------------------------------------------------


def generation_rows(spark: E, d: str) -> DataFrame:
    return services.generations(v.revisions(spark, d), "service", ["at_s", "id"], ["priority"])


@query("SELECT id, service, before IS NOT NULL AND before <> priority AS material, generation FROM generations")
def service_generations(spark: E, d: str) -> DataFrame:
    return generation_rows(spark, d).select("id", "service", "material", "generation")


CONFIG = """'{"priority":"' || priority || '","status":"' || status || '"}'"""


@query(
    f"""SELECT id, service, row_number() OVER (PARTITION BY service ORDER BY at_s, id) AS revision, {CONFIG} AS after, lag({CONFIG}) OVER (PARTITION BY service ORDER BY at_s, id) AS before
FROM revisions"""
)
def service_history(spark: E, d: str) -> DataFrame:
    out = services.history(v.revisions(spark, d), "service", ["at_s", "id"], ["priority", "status"])
    return out.select("id", "service", F.col("revision").cast("long").alias("revision"), "after", "before")


@query("SELECT id, service, generation FROM generations g WHERE generation >= (SELECT max(generation) FROM generations h WHERE h.service = g.service)")
def model_invalidation(spark: E, d: str) -> DataFrame:
    rows = generation_rows(spark, d).select("id", "service", "generation")
    active = rows.groupBy("service").agg(F.max("generation").alias("active"))
    return services.invalidated(rows, active, "service").select("id", "service", "generation")


@query("SELECT service, arg_max(interval_s, at_s * 100000000 + id) AS interval_s FROM revisions GROUP BY service HAVING arg_max(status, at_s * 100000000 + id) <> 'P'")
def active_services(spark: E, d: str) -> DataFrame:
    """Services whose latest configuration is not paused, with its interval."""
    last = v.revisions(spark, d).groupBy("service").agg(F.max_by(F.struct("interval_s", "status"), F.struct("at_s", "id")).alias("c"))
    return last.where("c.status <> 'P'").select("service", "c.interval_s")


REQUEST = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN ' ' ELSE s_name END AS name,
  CASE WHEN s_suppkey % 7 = 0 THEN 'ftp://host' ELSE 'https://host/' || s_suppkey END AS url, CAST(s_nationkey AS BIGINT) AS interval_s,
  CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey END AS start, CASE WHEN s_suppkey % 3 > 0 THEN 50 END AS stop FROM supplier"""


@query(
    f"""SELECT id, concat_ws(',', CASE WHEN trim(name) = '' THEN 'name' END, CASE WHEN NOT regexp_matches(url, '^https?://[^/\\s]+') THEN 'url' END, CASE WHEN interval_s < 15 THEN 'interval' END,
  CASE WHEN (start IS NULL) <> (stop IS NULL) THEN 'range' END, CASE WHEN start >= stop THEN 'range order' END) AS violations FROM ({REQUEST})"""
)
def validate_services(spark: E, d: str) -> DataFrame:
    i = F.col("s_suppkey")
    rows = v.table(spark, d, "supplier").select(
        i.alias("id"),
        F.when(i % 11 == 0, " ").otherwise(F.col("s_name")).alias("name"),
        F.when(i % 7 == 0, "ftp://host").otherwise(F.concat(F.lit("https://host/"), i.cast("string"))).alias("url"),
        F.col("s_nationkey").alias("interval_s"),
        F.when(i % 5 > 0, i).alias("start"),
        F.when(i % 3 > 0, 50).alias("stop"),
    )
    return rows.select("id", services.violations(*[F.col(c) for c in ("name", "url", "interval_s", "start", "stop")]).alias("violations"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '#00000007')")
def service_search(spark: E, d: str) -> DataFrame:
    return services.search(v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "  #00000007 ")


# --- health ------------------------------------------------------------------------------------------------------

KIND_SQL = "CASE kind WHEN 'error' THEN 'collection_failed' WHEN 'click' THEN 'collection_succeeded' WHEN 'view' THEN 'tracking_started' ELSE 'note' END"


def log(spark: E, d: str) -> DataFrame:
    return v.attempts(spark, d).withColumn("kind", F.expr(KIND_SQL))


LOG = f"SELECT service, us, id, {KIND_SQL} AS kind FROM attempts"


@query(
    f"""SELECT service, coalesce(arg_max(CASE kind WHEN 'tracking_started' THEN 'collecting' WHEN 'collection_succeeded' THEN 'healthy' WHEN 'collection_failed' THEN 'degraded' END, us * 10 + id % 10)
    FILTER (kind <> 'note'), 'pending') AS state,
  min(us) FILTER (kind = 'tracking_started') AS started_us, max(us) FILTER (kind = 'collection_succeeded') AS success_us, max(us) FILTER (kind = 'collection_failed') AS error_us,
  max(us) FILTER (kind = 'collection_failed') IS NOT NULL AND (max(us) FILTER (kind = 'collection_succeeded') IS NULL
    OR max(us * 10 + id % 10) FILTER (kind = 'collection_failed') > max(us * 10 + id % 10) FILTER (kind = 'collection_succeeded')) AS failing
FROM ({LOG}) GROUP BY service"""
)
def service_health(spark: E, d: str) -> DataFrame:
    return health.service_health(log(spark, d))


@query(f"SELECT service, id, n FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY us DESC, id DESC) AS n FROM ({LOG})) WHERE n <= 50")
def activity_feed(spark: E, d: str) -> DataFrame:
    return health.activity(log(spark, d)).select("service", "id", F.col("n").cast("long").alias("n"))


JOB_STATE = "CASE c_custkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'building' WHEN 3 THEN 'complete' ELSE 'failed' END"
BEAT = f"CASE WHEN c_custkey % 7 > 0 THEN {NOW} - CAST(c_nationkey AS BIGINT) * 2500000 END"


@query(
    f"""SELECT id, CASE WHEN state IN ('queued', 'running', 'building') AND (beat IS NULL OR beat < {NOW} - 30000000) THEN 'failed' ELSE state END AS state
FROM (SELECT c_custkey AS id, {JOB_STATE} AS state, {BEAT} AS beat FROM customer)"""
)
def stale_jobs(spark: E, d: str) -> DataFrame:
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(JOB_STATE).alias("state"), F.expr(BEAT).alias("heartbeat_us"))
    return health.stale_jobs(rows, NOW).select("id", "state")


@query(
    """SELECT service, count(*) FILTER (status = 'firing') AS firing, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'firing' AND severity = 'critical') AS critical
FROM anomalies GROUP BY ROLLUP (service)"""
)
def status_summary(spark: E, d: str) -> DataFrame:
    return health.status_summary(a.conditions(anomaly_events(spark, d), SI), "service")


@query("SELECT h.service, h.alert, h.id FROM hits h JOIN anomalies n USING (alert) WHERE n.status = 'firing' AND NOT coalesce(h.review_override, false)")
def reviewable_by_service(spark: E, d: str) -> DataFrame:
    events = anomaly_events(spark, d)
    hits = a.occurrences(events, SI).join(a.conditions(events, SI).select("alert", "status"), "alert")
    return health.reviewable(hits, "service")


@query(f"SELECT CAST(c_nationkey AS BIGINT) AS service, c_custkey AS id, {JOB_STATE} AS state FROM customer")
def jobs_by_service(spark: E, d: str) -> DataFrame:
    rows = v.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("service"), F.col("c_custkey").alias("id"), F.expr(JOB_STATE).alias("state"))
    return health.jobs_of_services(rows)
