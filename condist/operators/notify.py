"""Notification rows: what to send, in which state a delivery is, when to try again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RETRY_S = 300
REFRESH_S = 120


def plan(hits: DataFrame, alerts: DataFrame, threshold: int = 3) -> DataFrame:
    """Rows (alert, operation, severity, us): a firing row for each occurrence; at the threshold the warning form is
    resolved; when the alert ends, each severity that was sent is resolved once."""
    level = F.when(F.col("n") >= threshold, "critical").otherwise("warning")
    firing = hits.select("alert", F.lit("firing").alias("operation"), level.alias("severity"), "us")
    retired = hits.where(F.col("n") == threshold).select("alert", F.lit("resolved").alias("operation"), F.lit("warning").alias("severity"), "us")
    sent = F.when(F.col("occurrences") >= threshold, F.array(F.lit("critical"), F.lit("warning"))).otherwise(F.array(F.lit("warning")))
    ended = alerts.where("status = 'resolved'").select("alert", F.lit("resolved").alias("operation"), F.explode(sent).alias("severity"), F.col("resolved_us").alias("us"))
    return firing.unionByName(retired).unionByName(ended)


def resolutions(deliveries: DataFrame, ended: DataFrame, order: list[str]) -> DataFrame:
    """A resolved row for each severity of an ended alert (alert, ended_us) that was delivered, with the payload that was delivered last.

    ``deliveries`` have alert, operation, state, severity, payload and the
    columns of ``order``. What was never handed on needs no resolution.
    """
    sent = deliveries.where("operation = 'firing' and state = 'delivered'").groupBy("alert", "severity").agg(F.max_by("payload", F.struct(*order, "payload")).alias("payload"))
    return sent.join(ended.select("alert", "ended_us"), "alert").select("alert", F.lit("resolved").alias("operation"), "severity", "payload", F.col("ended_us").alias("us"))


def payload(alert: Column, service: Column, indicator: Column, kind: Column, severity: Column) -> Column:
    """A notification's body as JSON."""
    labels = F.create_map(F.lit("alert_id"), alert.cast("string"), F.lit("alert_type"), kind)
    return F.to_json(F.struct(alert.alias("alertId"), service.alias("service"), F.coalesce(indicator.cast("string"), F.lit("")).alias("indicator"), kind.alias("alertName"), severity.alias("severity"), labels.alias("labels")))


def states(deliveries: DataFrame, resolved: DataFrame) -> DataFrame:
    """By alert: delivered, pending and missed firing rows and the state of the alert.

    A pending firing row of a resolved alert is missed; an alert of which
    nothing was delivered is missed once it is resolved.
    """
    r = resolved.select("alert").distinct().withColumn("done", F.lit(True))
    rows = deliveries.where("operation = 'firing'").join(r, "alert", "left")
    state = F.when((F.col("state") == "pending") & F.coalesce("done", F.lit(False)), "missed").otherwise(F.col("state"))
    out = rows.withColumn("now", state).groupBy("alert").agg(
        *[F.count_if(F.col("now") == s).alias(s) for s in ("delivered", "pending", "missed")], F.coalesce(F.bool_or("done"), F.lit(False)).alias("done")
    )
    whole = F.when(F.col("delivered") > 0, "delivered").when(F.col("done") | (F.col("pending") == 0), "missed").otherwise("pending")
    return out.select("alert", "delivered", "pending", "missed", whole.alias("state"))


def due(deliveries: DataFrame, now_us: int) -> DataFrame:
    """Pending rows whose time has come."""
    return deliveries.where((F.col("state") == "pending") & (F.col("us") <= now_us))


def retry_s(attempts: Column) -> Column:
    """Seconds to the next try: two to the attempts, five minutes at most."""
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(20))), F.lit(float(MAX_RETRY_S))).cast("long")


def stale(deliveries: DataFrame, firing: DataFrame, now_us: int, order: list[str], also: Sequence[str] = ()) -> DataFrame:
    """Firing alerts to send again: sent before, last handoff over two minutes ago or never, nothing pending; with the
    severity and the columns ``also`` (the payload) of the latest firing row."""
    fired = deliveries.where("operation = 'firing'")
    latest = F.struct(*order, "severity", *also)
    last = fired.groupBy("alert").agg(*[F.max_by(c, latest).alias(c) for c in ("severity", *also)], F.max(F.when(F.col("state") == "delivered", F.col("us"))).alias("handed_us"))
    pending = deliveries.where("state = 'pending'").select("alert").distinct()
    old = F.col("handed_us").isNull() | (F.col("handed_us") < now_us - REFRESH_S * 1_000_000)
    return firing.select("alert").distinct().join(last, "alert").where(old).join(pending, "alert", "left_anti")
