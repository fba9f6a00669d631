"""Writes as latest-wins tables: chunks behind a generation guard, verdicts, backlog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condist.functions.lookup import latest


def chunk_upsert(writes: DataFrame, keys: list[str]) -> DataFrame:
    """The chunk that stands after all writes: of the newest generation, its latest write."""
    return latest(writes, keys, F.desc("generation"), F.desc("collected_at"), F.desc("id"))


def read_chunks(chunks: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks of the ``wanted`` keys; a key without a chunk is an error."""
    found = wanted.select(*keys).join(chunks.withColumn("_there", F.lit(True)), keys, "left")
    missing = F.concat(F.lit("no chunk of "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return found.where(F.coalesce("_there", F.raise_error(missing).cast("boolean"))).drop("_there")


def generation_guard(rows: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Rows of the active generation of their service; a generation of zero or less always passes."""
    joined = rows.join(active.select(key, F.col("generation").alias("active")), key, "left")
    return joined.where((F.col("generation") <= 0) | (F.col("generation") == F.col("active"))).drop("active")


def verdict_upsert(verdicts: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The latest verdict of each chunk; one of another generation than the chunk's leaves it pending."""
    current = chunks.select(*keys, F.col("generation").alias("chunk_generation"))
    matching = verdicts.join(current, keys).where(F.col("generation") == F.col("chunk_generation"))
    last = latest(matching, keys, F.desc("analysed_at"), F.desc("id")).select(*keys, "state")
    return current.join(last, keys, "left").select(*keys, F.col("chunk_generation").alias("generation"), F.coalesce("state", F.lit("pending")).alias("state"))


def fan_out(results: DataFrame, chunks: DataFrame, window: list[str], us: str = "us") -> DataFrame:
    """A window's result on each of its chunks; ``primary`` marks the last, which alone may move alerts."""
    last = F.max(us).over(Window.partitionBy(*window))
    return chunks.join(results, window).withColumn("primary", F.col(us) == last)
