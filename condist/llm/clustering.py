"""Centroid clustering of integer vectors by a bisector tournament.

Two centroids a and b split space at their bisector: with the integer normal
n = 2 (b - a) and threshold t = |b|^2 - |a|^2, b is the nearer one exactly
where n.x > t. Normals and thresholds of all pairs are computed once a round;
for a vector the best centroid so far meets the next one in one sign test
each, so k - 1 tests leave the winner, and a zero favours the smaller number.
Only the winner's distance is computed. All arithmetic is in integers.

Vectors are never shuffled: a round is one pass over a stored table whose
tasks hand on sums by centroid and component, which Spark adds up. What comes
to the driver is k centroids and k totals.

Defined cases: a vector that is null, of another length, or that holds a null
or non-finite component takes no part; components of any finite size are
exact (numbers over 26 bits go through Python's integers, and travel between
tasks in limbs of 30 bits), but a distance or an inertia that a long cannot
hold is null; with fewer than k kept vectors there are as many centroids as
vectors; rows that repeat are vectors of their own, and of equal hashes the
lesser vector is drawn first; a null vec_id hashes like an empty one; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.llm.scratch import written

#: Components under this in size are added and multiplied as 64-bit integers.
NARROW = 1 << 26
#: Vectors that meet the centroids at once.
ROWS = 4096
LIMB = 30
LONG = 1 << 63


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: 64-bit integers where all are narrow, else Python's; ``scale`` is a power of two."""
    if not values.size or float(np.abs(values).max()) * scale < NARROW:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(x) >= NARROW for c in centroids for x in c)
        self.centroids = np.array(centroids, object if wide else np.int64)
        c = self.centroids
        norms = (c * c).sum(1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])  # [a, b]: from a to b
        self.thresholds = norms[None, :] - norms[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it."""
        best = np.zeros(len(x), np.int64)
        if x.dtype == object or self.centroids.dtype == object:
            x = x.astype(object)
        for b in range(1, len(self.centroids)):
            side = (self.normals[best, b] * x).sum(1) - self.thresholds[best, b]
            best[(side > 0).astype(bool)] = b
        gap = x - self.centroids[best]
        return best, (gap * gap).sum(1)


def _matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return integers(values.reshape(-1, dims), scale)


def _limbs(total: int) -> Iterator[int]:
    """Digits of a number in base 2 ** LIMB, lowest first, all with its sign."""
    sign, rest = (-1, -total) if total < 0 else (1, total)
    while rest:
        yield sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and the vectors with exactly ``dims`` finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == dims)).where(finite)


def seeds(rows: DataFrame, k: int, salt: int, scale: int) -> list[list[int]]:
    """The k kept vectors with the smallest SHA-256 of ``salt:vec_id``, in the order of the hash."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = rows.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return [[int(n) for n in integers(np.array([r.v], np.float64), scale)[0]] for r in first.collect()]


def moved(rows: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after one round: floors of the means of their vectors; one without vectors stays."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Bisectors(centroids)
        counts = np.zeros(len(centroids), np.int64)
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column("v").slice(at, ROWS), dims, scale)
                best, _ = tests.nearest(x)
                for c in np.unique(best).tolist():
                    own = x[best == c]
                    counts[c] += len(own)
                    before = totals.get(c, [0] * dims)
                    totals[c] = [a + int(b) for a, b in zip(before, own.sum(0), strict=True)]
        cells = [(c, -1, 0, int(counts[c])) for c in totals]
        cells += [(c, i, j, limb) for c, sums in totals.items() for i, s in enumerate(sums) for j, limb in enumerate(_limbs(s))]
        columns = [pa.array([r[f] for r in cells], t) for f, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.record_batch(columns, ["cluster", "place", "limb", "n"])

    parts = rows.select("v").mapInArrow(run, "cluster int, place int, limb int, n long")
    sums = {(r.cluster, r.place, r.limb): r.n for r in parts.groupBy("cluster", "place", "limb").agg(F.sum("n").alias("n")).collect()}
    out = [list(c) for c in centroids]
    totals = {c: [0] * dims for c, place, _ in sums if place < 0}
    for (c, place, limb), n in sums.items():
        if place >= 0:
            totals[c][place] += n << (LIMB * limb)
    for c, values in totals.items():
        out[c] = [s // sums[c, -1, 0] for s in values]
    return out


def assigned(rows: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """vec_id, cluster and distance of each vector."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Bisectors(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                best, far = tests.nearest(_matrix(part.column("v"), dims, scale))
                far = [int(d) if d < LONG else None for d in far.tolist()]
                yield pa.record_batch([part.column("vec_id"), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: int = 2, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Components become floor(scale * x). Inertias are sums of squared distances
    over a cluster and over all; the digest is of the centroid's components as
    decimal integers, joined by commas.
    """
    spark = vectors.sparkSession
    rows = written(kept(vectors, dims), "vectors")
    centroids = seeds(rows, k, salt, scale)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    found = written(assigned(rows, centroids, scale), "assigned")
    unknown = F.bool_or(F.col("distance").isNull())
    sums = found.groupBy("cluster").agg(F.when(~unknown, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("sum")).collect()
    own = {r.cluster: None if r["sum"] is None else int(r["sum"]) for r in sums}
    whole = None if None in own.values() else sum(own.values())
    fits = lambda n: n if n is not None and n < LONG else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    totals = [(c, fits(n), fits(whole), digests[c]) for c, n in own.items()]
    # one row for each centroid
    table = spark.createDataFrame(totals, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings of 64 finite components: 40 centroids, five rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op13_sql(k: int = 40, rounds: int = 5, salt: int = 2, dims: int = 64) -> str:
    """The same by plain distances to all centroids."""
    steps = [
        f"""x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS c, v FROM x ORDER BY sha256('{salt}:' || vec_id) LIMIT {k})"""
    ]
    near = "a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := m.c)) AS b FROM x, c{i} m GROUP BY r)"
    for i in range(rounds + 1):
        steps.append(near.format(i=i))
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT c, list(m ORDER BY j) AS v FROM (
  SELECT c, j, (s - ((s % n) + n) % n) // n AS m FROM (SELECT a.b.c AS c, j, CAST(sum(x.v[j]) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} a USING (r), generate_series(1, {dims}) g(j) GROUP BY 1, 2)) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(s.v, c.v) AS v FROM c{i} c LEFT JOIN s{i} s USING (c))"""
            )
    last = f"a{rounds}"
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT x.vec_id, CAST(a.b.c AS INTEGER) AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM x JOIN {last} a USING (r) JOIN c{rounds} m ON m.c = a.b.c"""
    )


OP13_SQL = _op13_sql()
