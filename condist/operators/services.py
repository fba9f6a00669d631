"""Service configuration: generations, history, model invalidation, validation and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_INTERVAL_S = 15


def generations(revisions: DataFrame, key: str, order: list[str], material: list[str]) -> DataFrame:
    """Revisions with ``material`` (one of those columns changed) and ``generation``, from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*material)
    before = F.lag(now).over(w)
    rows = revisions.withColumn("material", before.isNotNull() & ~before.eqNullSafe(now))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("generation", 1 + F.sum(F.when(F.col("material"), 1).otherwise(0)).over(upto))


def history(revisions: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each revision with its number and the configuration before and after it as JSON."""
    w = Window.partitionBy(key).orderBy(*order)
    after = F.to_json(F.struct(*columns))
    return revisions.withColumn("after", after).withColumn("before", F.lag("after").over(w)).withColumn("revision", F.row_number().over(w))


def invalidated(models: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Model versions that survive: those of their service's active generation."""
    return models.join(active, key).where(F.col("generation") >= F.col("active")).drop("active")


def violations(name: Column, url: Column, interval_s: Column, start: Column, end: Column) -> Column:
    """The rules that a service request breaks, comma-separated; empty if none."""
    rules = [
        (F.coalesce(F.trim(name), F.lit("")) == "", "name"),
        (~F.coalesce(url.rlike(r"^https?://[^/\s]+"), F.lit(False)), "url"),
        (interval_s < MIN_INTERVAL_S, "interval"),
        (start.isNull() != end.isNull(), "range"),
        (start >= end, "range order"),
    ]
    return F.concat_ws(",", *[F.when(broken, rule) for broken, rule in rules])


def search(services: DataFrame, term: str, name: str = "name") -> DataFrame:
    """Services whose name contains the term, case and outer blanks apart; an empty term matches all."""
    wanted = term.strip().lower()
    return services.where(F.lower(name).contains(wanted)) if wanted else services
