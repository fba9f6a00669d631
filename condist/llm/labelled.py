"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, doc_id: Column | None = None) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; null for a null doc_id."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, column: str, use: Column, per_class: int) -> DataFrame:
    """Documents with a label: doc_id, text, label; at most ``per_class`` of each class.

    ``use`` says which doc_ids may be learned from. A document with several
    labels has the largest. The sample takes the doc_ids with the smallest
    hashes, so it does not depend on order; its ids are few enough to
    broadcast (2 * per_class rows of two numbers), so only its texts are
    shuffled. Of several texts with one doc_id it has that of the least hash.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .where(use)
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("label"))
    )
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for label in (0, 1):
        part = rows.where(F.col("label") == label).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row")).select("doc_id", "row.text", "label")


def prior(labels: DataFrame, column: str, use: Column) -> float:
    """Share of label 1 among all rows that may be learned from, a little smoothed."""
    row = labels.where(use & F.col(column).isin(0, 1)).agg(F.sum(column).alias("ones"), F.count("*").alias("all")).first()
    return ((row["ones"] or 0) + 0.5) / (row["all"] + 1)
