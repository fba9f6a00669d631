"""Samples and chunks: value counts, histogram increases, weighted means, merges and checked totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_samples(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Distinct values with their multiplicities (c), in long form."""
    return rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))


def nested(samples: DataFrame, keys: list[str], name: str = "samples") -> DataFrame:
    """Samples of a key as one ascending array of (v, c); a chunk is bounded by its window."""
    return samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias(name))


def weighted_mean(v: str = "v", c: str = "c") -> Column:
    """Sum of v * c over sum of c; 0 if there is no weight."""
    return F.when(F.sum(c) == 0, 0.0).otherwise(F.try_divide(F.sum(F.col(v) * F.col(c)), F.sum(c)))


def usable(v: str = "v") -> Column:
    return F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(F.col(v)) < float("inf"))


def checked_mean(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean over several chunks, with ``problem`` where a count is zero or a value not finite."""
    problem = F.when(F.bool_or(F.col("c") <= 0), "zero count").when(F.bool_or(~usable()), "value is not finite")
    out = samples.groupBy(*keys).agg(problem.alias("problem"), weighted_mean().alias("mean"))
    return out.withColumn("mean", F.when(F.col("problem").isNull(), F.col("mean")))


def merge(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of equal values added up; an overflow raises."""
    return samples.groupBy(*keys, "v").agg(F.sum("c").alias("c"))


def totals(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Total count, entries and entries with a count of each chunk; ``valid`` if the total is positive."""
    out = samples.groupBy(*keys).agg(F.sum("c").alias("total"), F.count("*").alias("entries"), F.count_if(F.col("c") > 0).alias("nonempty"))
    return out.withColumn("valid", F.col("total") > 0)


def time_of_day(us: str) -> Column:
    """Second of the UTC day of a window's end."""
    return F.expr(f"pmod({us} div 1000000, 86400)")


def load_latency(loads: DataFrame, latencies: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks (x and y sample arrays) of the windows that have both metrics."""
    return nested(loads, keys, "x").join(nested(latencies, keys, "y"), keys)


def histogram_increase(scrapes: DataFrame, series: list[str]) -> DataFrame:
    """Positive increases of cumulative bucket counts between consecutive scrapes, added up by upper bound.

    ``scrapes``: series columns, seq (1, 2, ...), upper, count. Only a bound
    present in both scrapes counts; decreases are counter resets; the infinite
    bound and zero sums are dropped.
    """
    w = Window.partitionBy(*series, "upper").orderBy("seq")
    steps = scrapes.withColumn("p", F.lag("count").over(w)).withColumn("ps", F.lag("seq").over(w)).where("ps = seq - 1")
    grown = steps.where(F.col("upper") < float("inf")).groupBy(*series, "upper").agg(F.sum(F.greatest(F.col("count") - F.col("p"), F.lit(0))).alias("increase"))
    return grown.where("increase > 0")
