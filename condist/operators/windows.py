"""Windows: assignment, plans, transitions after an interval change, gaps and import summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condist.functions.times import window_end


def assign(obs: DataFrame, interval: int, us: str = "us") -> DataFrame:
    """Right-closed windows: ``w`` is the end in microseconds of the window (w - interval, w] that holds the row."""
    return obs.withColumn("w", window_end(us, interval))


def plan(ranges: DataFrame, interval: int) -> DataFrame:
    """Contiguous windows of each range (start_us, end_us]: n (from 0), w_start, w_end, step_s; the last may be partial."""
    count = F.expr(f"(end_us - start_us + {interval} - 1) div {interval}")
    steps = ranges.where("end_us > start_us").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    start = F.col("start_us") + F.col("n") * interval
    end = F.least(F.col("start_us") + (F.col("n") + 1) * interval, F.col("end_us"))
    return steps.withColumn("w_start", start).withColumn("w_end", end).withColumn("step_s", F.least(F.lit(interval), end - start).cast("double") / 1_000_000)


def transitions(revisions: DataFrame) -> DataFrame:
    """Windows between an interval change and the first boundary of the new interval.

    ``revisions``: key, at (seconds; where the last window ended), old_s and
    new_s. The span up to the next multiple of new_s is cut into steps of at
    most max(old_s, new_s), without gap or overlap: n, w_start, w_end.
    """
    boundary = F.expr("(at + new_s - 1) div new_s * new_s")
    rows = revisions.withColumn("boundary", boundary).where("boundary > at").withColumn("cap", F.greatest("old_s", "new_s"))
    steps = F.expr("sequence(0L, (boundary - at + cap - 1) div cap - 1)")
    out = rows.withColumn("n", F.explode(steps)).withColumn("w_start", F.col("at") + F.col("n") * F.col("cap"))
    return out.withColumn("w_end", F.least(F.col("w_start") + F.col("cap"), F.col("boundary"))).drop("cap")


def gaps(planned: DataFrame, collected: DataFrame, keys: list[str]) -> DataFrame:
    """Planned windows without usable metrics."""
    return planned.join(collected.select(*keys).distinct(), keys, "left_anti")


def import_summary(planned: DataFrame, collected: DataFrame, keys: list[str]) -> DataFrame:
    """By service: total, imported and gap windows, and percent done at the last imported window (floor)."""
    have = collected.select(*keys).distinct().withColumn("have", F.lit(True))
    rows = planned.join(have, keys, "left")
    done = F.max(F.when(F.col("have"), F.col("w_end")))
    out = rows.groupBy("service").agg(
        F.count("*").alias("total"),
        F.count_if("have").alias("imported"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        done.alias("done_us"),
    )
    percent = F.floor(100 * (F.coalesce("done_us", "start_us") - F.col("start_us")) / (F.col("end_us") - F.col("start_us")))
    return out.select("service", "total", "imported", (F.col("total") - F.col("imported")).alias("gaps"), percent.cast("long").alias("percent"))


def completion(summary: DataFrame, cancelled: Column | None = None) -> DataFrame:
    """Job state and progress from an import summary."""
    state = F.when(F.lit(False) if cancelled is None else cancelled, "cancelled").when(F.col("imported") == 0, "failed").when(F.col("gaps") > 0, "complete_with_gaps").otherwise("complete")
    out = summary.withColumn("state", state)
    return out.withColumn("progress", F.when(F.col("state").startswith("complete"), 100).otherwise(F.col("percent")).cast("long"))


def revisions(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each interval change of a key with the interval before it: old_s, new_s."""
    w = Window.partitionBy(key).orderBy(*order)
    return changes.withColumn("old_s", F.lag("interval_s").over(w)).withColumnRenamed("interval_s", "new_s").where("old_s is not null and old_s <> new_s")
