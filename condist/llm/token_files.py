"""Token-id files: Parquet with one list of ids per document, in ascending doc_id order.

Ids are dictionary encoded by default (a page's ids are then bit-packed codes)
or delta encoded; row groups and pages have set sizes and page indexes are on,
so that a read of metadata skips the ids and a read of a few documents skips
most pages. Each file is one shard; ``shard`` and ``shard_start`` place a
document in its file, and a sum over the shards' totals places it in the whole.

Defined cases: a null text counts as empty, an empty text has the end id alone,
null doc_ids come first, rows of equal doc_id are ordered by the text's hash,
an empty table gives empty files and no rows, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condist.llm.scratch import shared_path
from condist.llm.tokens import default_tokenizer, encoder, slices

SCHEMA = "doc_id long, shard long, shard_start long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Each row's ids, with the end id; shards are the partitions of ``docs``, in their order."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encoder(path).column(part.column("text"))
                n = part.num_rows
                ids = np.insert(ids.astype(np.int32), bounds[1:], end_id)
                bounds = bounds + np.arange(n + 1)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(np.full(n, shard)),
                        pa.array(at + bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    ],
                    ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                at += len(ids)
        encoder(path).rest()

    return docs.mapInArrow(run, SCHEMA)


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 1000,
) -> None:
    """Write the documents' ids in ascending doc_id order. ``encoding`` is "dictionary" or "delta"."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.orderBy("doc_id", F.xxhash64("text"))
    options = {
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.dictionary.page.size": 1 << 20,
        "compression": "zstd",
    }
    encode(ordered, tokenizer, end_id).write.options(**options).parquet(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, shard of each document; reads no ids."""
    rows = spark.read.schema(SCHEMA).parquet(path).drop("ids")
    return _placed(rows, rows)


def documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The ids of documents low to high; row groups and pages outside that range are not read."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").between(low, high)).select("doc_id", "ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids and their number and crc32, all from the files."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return _placed(checksums(rows), rows)


def checksums(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by its length and the crc32 of its little-endian unsigned 32-bit form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            body = memoryview(lists.values.to_numpy().astype("<u4").tobytes())
            crcs = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            kept = [batch.column(x) for x in ("doc_id", "shard", "shard_start")]
            yield pa.record_batch([*kept, pa.array(np.diff(bounds).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, shard long, shard_start long, n_tokens long, ids_crc32 long")


def _placed(rows: DataFrame, stored: DataFrame) -> DataFrame:
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each file
    return rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base", "shard_start")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids and give start, length and checksum of each as read from the files."""
    path = shared_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
