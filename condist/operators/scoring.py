"""Scoring: one-sample Kolmogorov-Smirnov tests of chunks against conditional distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condist.functions.lookup import PART_ROWS, at_or_below, neighbours
from condist.functions.shared import stored
from condist.functions.stats import kolmogorov_p, linear, significant
from condist.operators.model import conditional_points


def levels(chunks: DataFrame, mass: DataFrame, model: list[str], known: int | None = None) -> DataFrame:
    """Chunks (with x), the level of x whose condition applies, and how many points that has."""
    sizes = mass.groupBy(*model, "x").agg(F.count("*").alias("points"))
    return at_or_below(chunks, sizes, model, "x", "level", also=["points"], known=known)


def probabilities(samples: DataFrame, points: DataFrame, model: list[str], known: int | None = None) -> DataFrame:
    """Samples (model, level, chunk, v, c) with f, the reference probability at v."""
    found = neighbours(samples, points.withColumnRenamed("x", "level"), [*model, "level"], "v", "p", known=known)
    return found.withColumn("f", linear(F.col("v")))


def ks(probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """Statistic d, scaled z and p-value of each chunk.

    The running count before a bucket is taken as its own count less one, and
    the scale is the root of the number of entries, not of observations.
    """
    w = Window.partitionBy(*keys)
    cum = F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = probabilities.withColumn("cum", cum).withColumn("n", F.sum("c").over(w))
    gap = F.greatest(F.abs(F.col("f") - (F.col("cum") - 1) / F.col("n")), F.abs(F.col("cum") / F.col("n") - F.col("f")))
    out = rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("c") > 0, gap)), F.lit(0.0)).alias("d"), F.count("*").alias("entries"), F.max("n").alias("n"))
    return out.withColumn("z", F.col("d") * F.sqrt("entries")).withColumn("p", kolmogorov_p(F.col("z")))


def analyse(chunks: DataFrame, samples: DataFrame, mass: DataFrame, model: list[str]) -> DataFrame:
    """Verdict of each chunk: model, w, x, level, points, d, z, p, state.

    Without a model or points a chunk is baseline; with one point, or no
    samples, it failed; else it is bad if its p-value is significant, or good.
    Only levels that some chunk needs are made into distribution functions.
    Samples and mass are best stored tables, as they are counted first. Where
    there are many, the rows of a level (its points, and the samples of its
    chunks) are bounded once, so that no lookup has to count its keys itself.
    """
    n = samples.count() + mass.count()
    known = stored(levels(chunks, mass, model, n), "levels")
    used = known.where("points >= 2")
    if n > PART_ROWS:
        entries = samples.groupBy(*model, "w").agg(F.count("*").alias("_entries"))
        sizes = used.join(entries, [*model, "w"]).groupBy(*model, "level").agg((F.max("points") + F.sum("_entries")).alias("_rows"))
        n = sizes.agg(F.max("_rows")).first()[0] or 0
    points = conditional_points(mass.join(used.select(*model, F.col("level").alias("x")), [*model, "x"], "left_semi"), model, n)
    scored = samples.join(used.select(*model, "w", "level"), [*model, "w"])
    tests = ks(probabilities(scored, points, model, n), [*model, "w"])
    out = known.join(tests, [*model, "w"], "left")
    state = (
        F.when(F.col("points").isNull(), "baseline")
        .when(F.col("p").isNull(), "failed")
        .when(significant(F.col("p")), "bad")
        .otherwise("good")
    )
    return out.withColumn("state", state)
