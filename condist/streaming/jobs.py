"""Structured Streaming jobs over the same functions as the batch queries.

A job has a folder: its checkpoint and its output are there, so a job that was
stopped, or that failed, is started again with the same folder and goes on
where it was. Batches that a sink writes go to folders by their number, so one
that is replayed after a failure replaces what it wrote.

Chunks close when the watermark passes their end. What arrives later than the
watermark allows is kept with the other arrivals; ``recovered`` finds the
windows that it belongs to, and ``rewritten`` makes their chunks again, until
a day after they were closed. Then they are gaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.functions.shared import shared_folder
from condist.functions.times import DAY

LATE = "24 hours"
KEYS = ["service", "indicator"]


def files(spark: SparkSession, schema: str, path: str, per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first, at most ``per_batch`` of them at a time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def finished(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append", sink: Callable | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return all that its job wrote, in this run and in earlier ones of that folder.

    ``sink`` takes a batch, the output's path and the batch's number, and
    writes below ``batch=<number>``.
    """
    folder = folder or shared_folder(spark, name)
    path = f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if sink:
        writer = writer.foreachBatch(lambda batch, number: sink(batch, path, number))
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
    return spark.read.parquet(path).drop("batch")


def chunks(observations: DataFrame, interval: str, late: str = LATE) -> DataFrame:
    """Samples of closed windows (start, end] of a stream of (service, ts, value): service, w (end in microseconds), v, c."""
    # windows are closed on the right, so a moment on a boundary counts a microsecond earlier
    rows = observations.withColumn("at", F.expr("ts - interval 1 microsecond")).withWatermark("at", late)
    counts = rows.groupBy("service", F.window("at", interval).alias("win"), F.col("value").alias("v")).agg(F.count("*").alias("c"))
    return counts.select("service", F.unix_micros("win.end").alias("w"), "v", "c")


def current_generation(stream: DataFrame, services: DataFrame) -> DataFrame:
    """Rows of each service's active generation, by a join with the static table."""
    return stream.join(services.select("service", "generation"), ["service", "generation"])


def recovered(observations: DataFrame, closed: DataFrame, interval_us: int, clock_us: int, late_us: int = DAY, expiry_us: int = DAY) -> DataFrame:
    """Windows (service, w) that are closed but whose stored observations are more than their chunks have, with what becomes of them.

    A window is closed ``late_us`` after its end. ``state`` is recovered within
    ``expiry_us`` of that: its chunk is to be written again, as a historical
    one. Else it is a gap.
    """
    end = F.expr(f"(us + {interval_us} - 1) div {interval_us} * {interval_us}")
    there = observations.groupBy("service", end.alias("w")).agg(F.count("*").alias("stored")).where(F.col("w") + late_us <= clock_us)
    have = closed.groupBy("service", "w").agg(F.sum("c").alias("chunked"))
    short = there.join(have, ["service", "w"], "left").where(F.col("stored") > F.coalesce("chunked", F.lit(0)))
    state = F.when(F.col("w") + late_us + expiry_us > clock_us, "recovered").otherwise("gap")
    return short.select("service", "w", (F.col("stored") - F.coalesce("chunked", F.lit(0))).alias("late"), state.alias("state"), F.lit(True).alias("historical"))


def rewritten(observations: DataFrame, closed: DataFrame, found: DataFrame, interval_us: int) -> DataFrame:
    """Closed chunks (service, w, v, c, historical) with those of recovered windows made again from all stored observations."""
    again = found.where("state = 'recovered'").select("service", "w")
    end = F.expr(f"(us + {interval_us} - 1) div {interval_us} * {interval_us}")
    fresh = observations.withColumn("w", end).join(again, ["service", "w"], "left_semi").groupBy("service", "w", F.col("value").alias("v")).agg(F.count("*").alias("c"))
    kept = closed.join(again, ["service", "w"], "left_anti").select("service", "w", "v", "c", F.lit(False).alias("historical"))
    return kept.unionByName(fresh.withColumn("historical", F.lit(True)))


def deduplicated(stream: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def scored(stream: DataFrame, spark: SparkSession, analyse: Callable[[DataFrame, DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """Verdicts of closed chunks: each micro-batch of samples goes through the batch analysis with the current model."""

    def sink(batch: DataFrame, path: str, number: int) -> None:
        batch.persist()
        loads = batch.groupBy("service", "w").agg(F.sum("c").cast("double").alias("x"))
        analyse(loads, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return finished(stream, spark, "scored", sink=sink, folder=folder)
