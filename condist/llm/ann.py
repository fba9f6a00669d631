"""Approximate nearest neighbours by collision-counting hashing.

Vectors are projected on random directions, one number each, and every
projection is a sorted array. A query opens a window around its own value in
each array and widens all windows in steps (virtual rehashing: no array is
built anew). A vector found in the windows of enough projections is verified
by its cosine. A query stops once a vector as near as its k-th best would
have been counted with the wanted probability.

Vectors go to blocks of bounded size by hash, queries too; a cell holds one
block of either, so all queries meet all rows in blocks and a task's memory
does not depend on the table. Each cell hands on its k best for each query.

Defined cases: rows with a null vec_id or a vector that is null, empty, all
zero or has a null or non-finite component take no part; a query meets only
vectors of its own length; vectors are scaled by powers of two before their
norm is taken, which changes no score but keeps the norms of very large and
very small ones finite; of rows that repeat a query's vec_id the least vector
asks and none is a candidate; equal scores go to smaller vec_ids; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import erf, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of a block of queries.
BLOCK, QUERIES = 8192, 4096


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (doubles) and d (their number) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(finite & F.exists("v", lambda x: x != 0))
        .withColumn("d", F.size("v"))
    )


def miss_chance(hashes: int, threshold: int, distance: float, half_width: float) -> float:
    """Chance that a vector at ``distance`` collides in fewer than ``threshold`` of the windows."""
    p = min(max(erf(half_width / (sqrt(2) * max(distance, 1e-12))), 1e-12), 1 - 1e-12)
    total = 0.0
    for i in range(threshold):
        total += np.exp(lgamma(hashes + 1) - lgamma(i + 1) - lgamma(hashes - i + 1) + i * log(p) + (hashes - i) * log(1 - p))
    return total


def safe_distances(hashes: int, threshold: int, widths: np.ndarray, miss: float) -> np.ndarray:
    """For each half width, the largest distance at which a vector is missed with chance ``miss`` at most."""
    low, high = 1e-6, 1e3  # the chance depends on distance / width alone
    for _ in range(60):
        mid = sqrt(low * high)
        low, high = (mid, high) if miss_chance(hashes, threshold, mid, 1.0) <= miss else (low, mid)
    return widths * low


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to between a half and one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hashes: int, share: float, miss: float, seed: int):
        self.ids, self.vectors = ids, scaled(vectors)
        vectors = self.vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1], hashes))
        self.units = vectors / self.norms[:, None]
        projected = self.units @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)
        self.threshold = int(np.ceil(share * hashes))
        # half widths from a small step up to windows that hold everything
        self.widths = 0.1 * 1.25 ** np.arange(40)
        self.safe = safe_distances(hashes, self.threshold, self.widths, miss)
        self.usual = 0  # one level under that at which the last query stopped, where the next one begins

    def search(self, queries: np.ndarray, owns: np.ndarray, k: int) -> list[list[tuple[int, float]]]:
        """For each query its k best (vec_id, cosine) found; all candidates if there are no more than k."""
        queries = scaled(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        centres = (queries / norms[:, None]) @ self.directions
        edges = self.widths[None, :]
        # places of all windows' ends in the sorted arrays: projections, queries, widths
        low = np.stack([np.searchsorted(row, centres[:, h, None] - edges, "left") for h, row in enumerate(self.sorted)])
        high = np.stack([np.searchsorted(row, centres[:, h, None] + edges, "right") for h, row in enumerate(self.sorted)])
        return [self._one(q, n, own, k, low[:, i], high[:, i]) for i, (q, n, own) in enumerate(zip(queries, norms, owns, strict=True))]

    def _one(self, query: np.ndarray, norm: float, own: int, k: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, float]]:
        n = len(self.ids)
        others = n - int((self.ids == own).sum())
        wanted, unit = min(k, others), query / norm
        counts, checked = np.zeros(n, np.int64), np.zeros(n, bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        # windows with too few entries in all cannot bring the wanted number over the threshold
        level = max(self.usual, int(np.argmax((high - low).sum(axis=0) >= self.threshold * max(wanted, 1))))
        a = b = low[:, level]
        for level in range(level, len(self.widths)):
            c, d = low[:, level], high[:, level]
            rings = [x for h, order in enumerate(self.order) for x in (order[c[h] : a[h]], order[b[h] : d[h]])]
            counts += np.bincount(np.concatenate(rings), minlength=n)
            a, b = c, d
            new = np.flatnonzero((counts >= self.threshold) & ~checked)
            checked[new] = True
            new = new[self.ids[new] != own]
            if len(new):
                near = self.units[new] @ unit
                found, scores = np.concatenate((found, new)), np.concatenate((scores, near))
                if len(found) > k:
                    # all that rounding could bring among the k best stay for the exact scores below
                    keep = scores >= np.partition(scores, -k)[-k] - 1e-9
                    found, scores = found[keep], scores[keep]
            if len(found) >= wanted and (not wanted or sqrt(max(0.0, 2 - 2 * np.partition(scores, -wanted)[-wanted])) <= self.safe[level] or checked.all()):
                break
        self.usual = level - 1
        exact = (self.vectors[found] * query).sum(axis=1) / (self.norms[found] * norm)
        ids = self.ids[found]
        best = np.lexsort((ids, -exact))[:k]
        return list(zip(ids[best].tolist(), exact[best].tolist(), strict=True))


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    hashes: int = 48,
    share: float = 0.5,
    miss: float = 0.02,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by cosine that are found for each row with ``is_query``.

    ``share`` of the windows must hold a vector before it is verified; ``miss``
    is the chance at which one as near as a query's k-th best is overlooked.
    """
    good = usable(rows)
    queries = good.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    n, q = good.count(), queries.count()
    columns, bands = max(1, -(-n // BLOCK)), max(1, -(-q // QUERIES))
    block = lambda salt, number: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    base = good.withColumn("i", block(1, columns)).withColumn("j", every(bands)).withColumn("query", F.lit(False))
    asked = queries.withColumn("j", block(2, bands)).withColumn("i", every(columns)).withColumn("query", F.lit(True))
    cells = base.unionByName(asked)

    def cell(table: pa.Table) -> pa.Table:
        flags = table.column("query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        out: list[tuple] = []
        if flags.any() and not flags.all():
            vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            index = Index(ids[~flags], vectors[~flags], hashes, share, miss, seed)
            asked = np.flatnonzero(flags)
            for at in np.array_split(asked, -(-len(asked) // 128)):
                for q, hits in zip(ids[at].tolist(), index.search(vectors[at], ids[at], k), strict=True):
                    out += [(q, i, s) for i, s in hits]
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = cells.groupBy("i", "j", "d").applyInArrow(cell, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose vec_id is divisible by 50, among all other rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
