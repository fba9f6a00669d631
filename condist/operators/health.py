"""Health of services and jobs from their event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State that an event puts its service in; other events leave it as it is.
STATES = {"tracking_started": "collecting", "collection_succeeded": "healthy", "collection_failed": "degraded", "collection_delayed": "degraded", "paused": "paused"}
STALE_S = 30


def state_of(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[kind]


def service_health(events: DataFrame, key: str = "service") -> DataFrame:
    """State, first start, last success and last error of each service; a success clears the error."""
    at = F.struct("us", "id")
    when = lambda kind: F.when(F.col("kind") == kind, F.col("us"))
    rows = events.withColumn("_state", state_of(F.col("kind")))
    last = lambda kind: F.max(F.when(F.col("kind") == kind, at))
    out = rows.groupBy(key).agg(
        F.max_by("_state", F.when(F.col("_state").isNotNull(), at)).alias("state"),
        F.min(when("tracking_started")).alias("started_us"),
        F.max(when("collection_succeeded")).alias("success_us"),
        F.max(when("collection_failed")).alias("error_us"),
        last("collection_succeeded").alias("_s"),
        last("collection_failed").alias("_f"),
    )
    failing = F.col("_f").isNotNull() & (F.col("_s").isNull() | (F.col("_f") > F.col("_s")))
    return out.select(key, F.coalesce("state", F.lit("pending")).alias("state"), "started_us", "success_us", "error_us", failing.alias("failing"))


def activity(events: DataFrame, key: str = "service", keep: int = 50) -> DataFrame:
    """The ``keep`` newest events of each service, newest first: n from 1."""
    w = Window.partitionBy(key).orderBy(F.desc("us"), F.desc("id"))
    return events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)


def stale_jobs(jobs: DataFrame, now_us: int) -> DataFrame:
    """Jobs with their state; one at work without a heartbeat in thirty seconds has failed."""
    working = F.col("state").isin("queued", "running", "building")
    old = F.col("heartbeat_us").isNull() | (F.col("heartbeat_us") < now_us - STALE_S * 1_000_000)
    return jobs.withColumn("state", F.when(working & old, "failed").otherwise(F.col("state")))


def status_summary(alerts: DataFrame, key: str) -> DataFrame:
    """Alerts by key and in all (key null): firing, resolved, firing critical."""
    return alerts.rollup(key).agg(
        F.count_if(F.col("status") == "firing").alias("firing"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if((F.col("status") == "firing") & (F.col("severity") == "critical")).alias("critical"),
    )


def reviewable(occurrences: DataFrame, key: str) -> DataFrame:
    """Occurrences of firing alerts that no review has accepted, by service."""
    rows = occurrences.where((F.col("status") == "firing") & ~F.col("review_override").eqNullSafe(True))
    return rows.select(F.coalesce(F.col(key), F.lit("unknown")).alias(key), "alert", "id").orderBy(key, "id")


def jobs_of_services(jobs: DataFrame, key: str = "service") -> DataFrame:
    """Jobs by service, newest (largest id) first."""
    return jobs.orderBy(key, F.desc("id"))
