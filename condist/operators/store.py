"""Chunks and their verdicts as a stored table, partitioned by service and day.

A write reads the partitions that it touches, merges, and replaces just those
(copy on write with dynamic overwrite); a point read opens only the partitions
of the wanted keys. Merging is by the guard of generations: a write of the
stored or a newer generation replaces the chunk, an older one is rejected; the
same generation keeps the verdict and the review, a newer one begins pending
and without review. A verdict counts if it is of the chunk's generation.

A merge is made in full before partitions are replaced, and making it again
gives the same rows, so a write that failed is repeated. There is one writer
at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.functions.lookup import latest
from condist.functions.shared import stored
from condist.functions.times import DAY

PARTITION = ["service", "day"]
VERDICT = ["state", "p", "analysed_at", "review_override"]


def day(us: str = "w") -> Column:
    """The day (since the epoch) that ends with or after a window's end."""
    return F.expr(f"({us} - 1) div {DAY}")


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table; one that is not there yet is empty."""
    like.limit(0).write.mode("ignore").partitionBy(*PARTITION).parquet(path)
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def _replace(rows: DataFrame, path: str) -> None:
    """Replace the partitions that rows fall into by the rows, which are made first."""
    stored(rows, "merged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)


def touched(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the table's partitions that hold any of ``rows``; partitions are pruned when the query runs."""
    parts = rows.select(*PARTITION).distinct().where(f"day > {-(1 << 40)}")
    return table.join(parts, PARTITION, "left_semi")


def write_chunks(spark: SparkSession, path: str, writes: DataFrame, keys: list[str]) -> None:
    """Merge chunk writes (keys with service and w, generation, collected_at, id, body) into the table at ``path``."""
    new = latest(writes, keys, F.desc("generation"), F.desc("collected_at"), F.desc("id")).withColumn("day", day())
    empty = {"state": F.lit("pending"), "p": F.lit(None).cast("double"), "analysed_at": F.lit(None).cast("long"), "review_override": F.lit(None).cast("boolean")}
    new = new.withColumns(empty)
    both = touched(_read(spark, path, new), new).withColumn("_stored", F.lit(True)).unionByName(new.withColumn("_stored", F.lit(False)))
    # the newest generation's verdict stays, whichever of its writes wins; rows of equal rank are told apart by what is stored
    order = [F.desc("generation"), F.desc("collected_at"), F.desc("id"), F.desc("_stored")]
    kept = both.where("_stored").select(*keys, F.col("generation").alias("_g"), F.struct(*VERDICT).alias("_verdict"))
    merged = latest(both, keys, *order).join(kept, keys, "left")
    same = F.col("generation") == F.col("_g")
    _replace(merged.withColumns({c: F.when(same, F.col(f"_verdict.{c}")).otherwise(F.col(c)) for c in VERDICT}).select(*new.columns), path)


def write_verdicts(spark: SparkSession, path: str, like: DataFrame, verdicts: DataFrame, keys: list[str]) -> None:
    """Merge verdicts (keys, generation, state, p, analysed_at) into the chunks; one of another generation changes nothing.

    ``like`` has the columns of the stored table (see ``table``).
    """
    rows = touched(like, verdicts.withColumn("day", day()))
    last = latest(verdicts.join(rows.select(*keys, "generation"), [*keys, "generation"], "left_semi"), keys, F.desc("analysed_at"), F.desc("state"))
    found = rows.join(last.select(*keys, F.struct("state", "p", "analysed_at").alias("_new")), keys, "left")
    newer = F.col("_new").isNotNull() & (F.col("analysed_at").isNull() | (F.col("_new.analysed_at") >= F.col("analysed_at")))
    _replace(found.withColumns({c: F.when(newer, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("state", "p", "analysed_at")}).select(*like.columns), path)


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_chunks(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks of the wanted keys; a key without a chunk is an error."""
    asked = wanted.select(*keys).distinct().withColumn("day", day())
    rows = touched(table(spark, path), asked)
    found = asked.drop("day").join(rows.withColumn("_there", F.lit(True)), keys, "left")
    missing = F.concat(F.lit("no chunk of "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return found.where(F.coalesce("_there", F.raise_error(missing).cast("boolean"))).drop("_there")
