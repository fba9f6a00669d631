"""Reference models in numbered versions, fed by their own verdicts.

Time is cut by publications. The chunks between two of them are scored with
the version in force, the newest one of the chunk's own generation that was
published before; their verdicts, and reviews that came meanwhile, say which
chunks may enter the next version. The mass behind the versions is never built
anew: a chunk that becomes eligible adds its pairs, one that a review takes
back subtracts them, and a new generation begins at nothing.

Every step writes to a folder of its number, so a step that is repeated after
a failure replaces what it wrote, and a publication for the same time is made
once. Folders, under the root:

- ``verdicts``: service, indicator, w, generation, version, x, level, points, d, z, p, state
- ``mass``: service, indicator, generation, x, v, n (kept by differences, of services that are not ready too)
- ``counts``: service, indicator, generation, eligible
- ``models``: service, indicator, generation, x, v, n of each publication, near values as one
- ``manifest``: service, indicator, generation, version, interval_end, eligible, pairs, checksum
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condist.functions.shared import stored
from condist.operators import model as m
from condist.operators.scoring import analyse

KEYS = ["service", "indicator"]
MODEL = [*KEYS, "generation"]
CHUNK = [*KEYS, "w"]
STEP = "step int"
VERDICTS = "service string, indicator int, w long, generation long, version long, x double, level double, points long, d double, z double, p double, state string"
MASS = "service string, indicator int, generation long, x double, v double, n long"
COUNTS = "service string, indicator int, generation long, eligible long"
MANIFEST = "service string, indicator int, generation long, version long, interval_end long, eligible long, pairs long, checksum string"


def read(spark: SparkSession, root: str, name: str, schema: str, steps: Sequence[int]) -> DataFrame:
    """Rows that the given steps wrote, with ``step``."""
    rows = None
    for k in steps:
        part = spark.read.schema(schema).parquet(f"{root}/{name}/{k}").withColumn("step", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    return spark.createDataFrame([], f"{schema}, {STEP}") if rows is None else rows


def write(rows: DataFrame, root: str, name: str, step: int) -> DataFrame:
    path = f"{root}/{name}/{step}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def active_at(services: DataFrame, us: int) -> DataFrame:
    """The generation of each service at a time, from (service, generation, since_us)."""
    return services.where(F.col("since_us") <= us).groupBy("service").agg(F.max("generation").alias("generation"))


def decided(reviews: DataFrame, us: int, name: str) -> DataFrame:
    """The last decision on each chunk up to a time, from (service, indicator, w, us, accept)."""
    return reviews.where(F.col("us") <= us).groupBy(*CHUNK).agg(F.max_by("accept", F.struct("us", "accept")).alias(name))


def checksum() -> Column:
    """Digest of a model's rows, whatever their order."""
    return F.sum(F.xxhash64("x", "v", "n").cast("decimal(20,0)")).cast("string")


def in_force(manifest: DataFrame) -> DataFrame:
    """The newest version of each key and generation, with the step that made it."""
    return manifest.groupBy(*MODEL).agg(F.max("version").alias("version"), F.max_by("step", "version").alias("step"))


def model_of(spark: SparkSession, root: str, force: DataFrame) -> DataFrame:
    """The models of versions (MODEL, version, step); only the steps that hold any are read."""
    steps = sorted(r.step for r in force.select("step").distinct().collect())
    return read(spark, root, "models", MASS, steps).join(force, [*MODEL, "step"]).drop("step")


def intact(spark: SparkSession, root: str, manifest: DataFrame, keep: int = 5) -> DataFrame:
    """Of the ``keep`` newest versions of a key, those whose stored rows have the published number and checksum."""
    kept = manifest.withColumn("_n", F.row_number().over(Window.partitionBy(*MODEL).orderBy(F.desc("version")))).where(F.col("_n") <= keep).drop("_n")
    steps = sorted(r.step for r in kept.select("step").distinct().collect())
    found = read(spark, root, "models", MASS, steps).groupBy(*MODEL, "step").agg(F.count("*").alias("_pairs"), checksum().alias("_sum"))
    return kept.join(found, [*MODEL, "step"]).where((F.col("pairs") == F.col("_pairs")) & (F.col("checksum") == F.col("_sum"))).drop("_pairs", "_sum")


def pairs(entries: DataFrame, samples: DataFrame) -> DataFrame:
    """Signed mass of chunks (MODEL, w, x, sign) by their samples."""
    rows = entries.join(samples, CHUNK)
    return rows.groupBy(*MODEL, "x", "v").agg(F.sum(F.col("sign") * F.col("c")).alias("n"))


def score(spark: SparkSession, root: str, step: int, chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Verdicts of the chunks of a step by the versions in force before it."""
    force = in_force(read(spark, root, "manifest", MANIFEST, range(1, step)))
    known = chunks.join(force.select(*MODEL, "version"), MODEL, "left")
    own = stored(samples.join(chunks.select(*CHUNK, "generation"), CHUNK), "own-samples")
    scored = analyse(known, own, model_of(spark, root, force).drop("version"), MODEL)
    return scored.select("service", "indicator", "w", "generation", "version", "x", "level", "points", "d", "z", "p", "state")


def advance(
    spark: SparkSession,
    root: str,
    step: int,
    start: int,
    end: int,
    chunks: DataFrame,
    samples: DataFrame,
    services: DataFrame,
    reviews: DataFrame,
    ready: Callable[[DataFrame], DataFrame],
) -> None:
    """One step: score the chunks of (start, end], and publish at ``end``.

    ``chunks`` are (service, indicator, w, x, generation), ``samples`` (service,
    indicator, w, v, c), ``ready`` adds a column of that name to counts of
    eligible chunks. A chunk of a generation that was superseded by the end of
    its window is not scored. A publication takes the generation that is active
    at its end.
    """
    since = services.select("service", F.col("generation").alias("_g"), "since_us")
    own = chunks.where((F.col("w") > start) & (F.col("w") <= end))
    current = own.join(since, "service").where("since_us <= w").groupBy(*own.columns).agg(F.max("_g").alias("_g")).where("generation = _g").drop("_g")
    current = stored(current, "collected")
    mine = samples.where((F.col("w") > start) & (F.col("w") <= end))
    fresh = write(score(spark, root, step, current, mine), root, "verdicts", step)

    # what enters and what leaves, as signs
    active = stored(active_at(services, end), "active")
    before, after = decided(reviews, start, "_before"), decided(reviews, end, "_after")
    entered = fresh.select(*MODEL, "w", "x", "state").withColumn("_was", F.lit(False)).join(after, CHUNK, "left").withColumn("_before", F.lit(None).cast("boolean"))
    touched = reviews.where((F.col("us") > start) & (F.col("us") <= end)).select(*CHUNK).distinct()
    earlier = read(spark, root, "verdicts", VERDICTS, range(1, step)).select(*MODEL, "w", "x", "state").join(touched, CHUNK, "left_semi")
    earlier = earlier.join(before, CHUNK, "left").join(after, CHUNK, "left").withColumn("_was", F.lit(True))
    both = entered.unionByName(earlier)
    sign = m.eligible("_after").cast("long") - (m.eligible("_before") & F.col("_was")).cast("long")
    entries = both.withColumn("sign", sign).where("sign <> 0").join(active, ["service", "generation"], "left_semi")
    entries = stored(entries.select(*MODEL, "w", "x", "sign", "_was"), "entries")

    previous = [step - 1] if step > 1 else []
    counts = read(spark, root, "counts", COUNTS, previous).drop("step").join(active, ["service", "generation"], "left_semi")
    counts = counts.unionByName(entries.select(*MODEL, F.col("sign").alias("eligible"))).groupBy(*MODEL).agg(F.sum("eligible").alias("eligible"))
    counts = write(counts, root, "counts", step)
    kept = read(spark, root, "mass", MASS, previous).drop("step").join(active, ["service", "generation"], "left_semi")
    # an earlier chunk that a review moves has its samples in an earlier stretch of the table
    moved = pairs(entries.where("_was"), samples.where(F.col("w") <= start)).unionByName(pairs(entries.where("not _was"), mine))
    mass = kept.unionByName(moved).groupBy(*MODEL, "x", "v").agg(F.sum("n").alias("n")).where("n <> 0")
    mass = write(mass, root, "mass", step)

    wanted = ready(counts).where("ready").select(*MODEL, "eligible")
    models = write(m.coalesce_near(mass.join(wanted.select(*MODEL), MODEL, "left_semi"), MODEL, by=("x",)).select("service", "indicator", "generation", "x", "v", "n"), root, "models", step)
    numbers = read(spark, root, "manifest", MANIFEST, range(1, step)).groupBy(*MODEL).agg(F.max("version").alias("_last"))
    bodies = models.groupBy(*MODEL).agg(F.count("*").alias("pairs"), checksum().alias("checksum"))
    rows = bodies.join(wanted, MODEL).join(numbers, MODEL, "left")
    rows = rows.select(*MODEL, (F.coalesce("_last", F.lit(0)) + 1).alias("version"), F.lit(end).alias("interval_end"), "eligible", "pairs", "checksum")
    write(rows, root, "manifest", step)


def learn(spark: SparkSession, root: str, start: int, ends: Sequence[int], chunks: DataFrame, samples: DataFrame, services: DataFrame, reviews: DataFrame, ready: Callable[[DataFrame], DataFrame]) -> int:
    """All steps, one for each publication time, in order; returns their number."""
    for step, end in enumerate(ends, 1):
        advance(spark, root, step, ends[step - 2] if step > 1 else start, end, chunks, samples, services, reviews, ready)
    return len(ends)
