"""Paths in the folder that driver and executors share, and memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder in local mode, and on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows from a Parquet table in the shared folder, which cuts their lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, compression: str = "zstd") -> DataFrame:
    """As ``written``, with the rows hashed by ``key`` into buckets: a join or grouping on it reads them without a shuffle."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(buckets, key).option("compression", compression).option("path", path).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry only: files of a table with a path stay
    return rows


@contextmanager
def small_batches(spark: SparkSession, limit: str = "8m") -> Iterator[None]:
    """Rows go to Python in batches of at most ``limit`` bytes by what is run meanwhile; texts of several tasks take much memory else."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frugal(run: Callable) -> Callable:
    """The same function over Arrow batches; when its task ends, the worker gives free memory back to the system.

    Workers are used again by later stages, and allocators keep what was freed.
    """

    def frugal_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return frugal_run
