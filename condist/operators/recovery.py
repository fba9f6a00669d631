"""Recovery of failed windows: the backlog, what becomes of an attempt, and retry delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condist.functions.lookup import latest

PROBE_S = 3600
#: Until a window that failed again is tried.
RETRY_US = 1_000_000


def upsert(failures: DataFrame, keys: list[str], lifetime_us: int) -> DataFrame:
    """One pending row for each failed window: attempts, first and last failure, last error, when it is tried again; it expires ``lifetime_us`` after the first."""
    return failures.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.max_by("error", F.struct("us", "id")).alias("error"),
        (F.min("us") + lifetime_us).alias("expires_us"),
        (F.max("us") + RETRY_US).alias("retry_us"),
        F.lit("pending").alias("state"),
    )


def oldest(backlog: DataFrame, key: str = "service") -> DataFrame:
    """The oldest open window of each service."""
    return latest(backlog, [key], F.col("w"))


def delay_s(attempts: Column, failing_s: Column) -> Column:
    """Seconds before the next try: a probe an hour once failing for an hour, else two to the (attempts - 1), a minute at most."""
    doubled = F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(10)))
    return F.when(failing_s >= PROBE_S, F.lit(PROBE_S)).otherwise(F.least(doubled, F.lit(60.0))).cast("long")


def backoff_s(attempts: Column, interval_s: Column) -> Column:
    """Seconds of the scheduler's backoff: doubling from one second up to the interval or an hour."""
    doubled = F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(30)))
    return F.least(doubled, interval_s.cast("double"), F.lit(float(PROBE_S))).cast("long")


def classify(attempts: DataFrame, now_us: int) -> DataFrame:
    """What an attempt at a window comes to (columns expires_us, ready_us, ok): outcome, wait_us, state."""
    outcome = (
        F.when(F.col("expires_us") <= now_us, "gap")
        .when(F.col("ready_us") > now_us, "deferred")
        .when(F.col("ok"), "completed")
        .otherwise("retry")
    )
    out = attempts.withColumn("outcome", outcome)
    state = F.when(F.col("outcome") == "gap", "expired").when(F.col("outcome") == "completed", "recovered").otherwise("pending")
    return out.withColumn("wait_us", F.when(F.col("outcome") == "deferred", F.col("ready_us") - now_us).otherwise(0)).withColumn("state", state)
