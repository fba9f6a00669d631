"""Ordered lookups and running sums without range joins, over keys of any size.

Rows of two tables stand in one window order. A key with more rows than one
task should take is dealt by ranges of the ordering value: splitters come from
the key's own counts, equal values stay in one part, and what a part must know
of the parts beside it (the last knot, the first knot, the sum so far) is a
scan over one row for each part. Keys of ordinary size are not dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that one task takes in order.
PART_ROWS = 1_000_000
#: Parts of a key at most; more rows make larger parts then.
PARTS = 1_000
#: Splitters that are sent to every task; more of them are joined.
SENT = 1_000_000


def dealt(rows: DataFrame, keys: Sequence[str], at: str, part_rows: int = PART_ROWS, known: int | None = None) -> tuple[DataFrame, bool]:
    """Rows with ``_part``, the number of their part of their key by value, and whether any key has several.

    ``known`` is a bound on the rows of any key (all rows are one), where the
    caller has one: keys need not be counted if one task could take that.
    """
    if known is not None and known <= part_rows:
        return rows.withColumn("_part", F.lit(0)), False
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    found = sizes.agg(F.max("_size"), F.sum(F.floor(F.col("_size") / part_rows))).first()
    if (found[0] or 0) <= part_rows:
        return rows.withColumn("_part", F.lit(0)), False
    parts = min(PARTS, -(-found[0] // part_rows))
    big = sizes.where(F.col("_size") > part_rows).select(*keys, F.least(F.lit(parts), F.ceil(F.col("_size") / part_rows)).cast("int").alias("_own"))
    cuts = rows.join(big, [*keys], "left_semi").groupBy(*keys).agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10 * parts).alias("_all"))
    # of the finest splitters a key takes as many as it needs
    own = F.transform(F.sequence(F.lit(1), F.col("_own") - 1), lambda j: F.get("_all", (j * parts / F.col("_own")).cast("int") - 1))
    splitters = cuts.join(big, [*keys]).select(*keys, own.alias("_cuts"))
    splitters = F.broadcast(splitters) if found[1] <= SENT else splitters
    under = F.size(F.filter("_cuts", lambda c: c < F.col(at)))
    return rows.join(splitters, [*keys], "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(under)).drop("_cuts"), True


def _over(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _beside(rows: DataFrame, keys: Sequence[str], **known: Column) -> DataFrame:
    """What each part must know of others: _before (last ``last`` of the parts before), _after (first ``first`` of those after), _least (least ``least`` of all)."""
    parts = rows.groupBy(*keys, "_part").agg(*[c.alias(f"_{name}_own") for name, c in known.items()])
    w = Window.partitionBy(*keys)
    up, down = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_part", F.desc("_part")))
    out = [F.last("_last_own", ignorenulls=True).over(up).alias("_before")]
    out += [F.last("_first_own", ignorenulls=True).over(down).alias("_after")] if "first" in known else []
    out += [F.min("_least_own").over(w).alias("_least")] if "least" in known else []
    return parts.select(*keys, "_part", *out)


def neighbours(probes: DataFrame, knots: DataFrame, keys: Sequence[str], at: str, value: str, part_rows: int = PART_ROWS, known: int | None = None) -> DataFrame:
    """Each probe with its nearest knots: below (lo_at, lo_value; strictly under) and above (hi_at, hi_value; at or over)."""
    knot = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    both = probes.withColumn("_order", F.lit(0)).unionByName(knots.select(*keys, at, knot.alias("_knot"), F.lit(1).alias("_order")), allowMissingColumns=True)
    rows, several = dealt(both, keys, at, part_rows, known)
    found = rows.withColumn("_lo", F.last("_knot", ignorenulls=True).over(_over(keys, at, "_order")))
    found = found.withColumn("_hi", F.last("_knot", ignorenulls=True).over(_over(keys, F.desc(at), F.desc("_order")))).where("_order = 0")
    if several:
        beside = _beside(rows, keys, last=F.max("_knot"), first=F.min("_knot"))
        found = found.join(beside, [*keys, "_part"]).withColumn("_lo", F.coalesce("_lo", "_before")).withColumn("_hi", F.coalesce("_hi", "_after"))
    return found.select(*probes.columns, *[F.col(f"_{s}.{f}").alias(f"{s}_{f}") for s in ("lo", "hi") for f in ("at", "value")])


def at_or_below(probes: DataFrame, levels: DataFrame, keys: Sequence[str], at: str, name: str, part_rows: int = PART_ROWS, also: Sequence[str] = (), known: int | None = None) -> DataFrame:
    """Each probe with the largest level at or under it (``name``), or the lowest level if there is none, and that level's columns ``also``; null without levels."""
    knot = F.struct(F.col(at).alias(name), *also)
    k = levels.select(*keys, at, knot.alias("_knot"), F.lit(0).alias("_order"))
    rows, several = dealt(probes.withColumn("_order", F.lit(1)).unionByName(k, allowMissingColumns=True), keys, at, part_rows, known)
    under = F.last("_knot", ignorenulls=True).over(_over(keys, at, "_order"))
    # probes under all levels take the lowest: that of the key's only part, or of the summary of its parts
    least = F.min("_knot").over(Window.partitionBy(*keys, "_part"))
    found = rows.select(*rows.columns, under.alias("_under"), *([] if several else [least.alias("_least")])).where("_order = 1")
    if several:
        beside = _beside(rows, keys, last=F.max("_knot"), least=F.min("_knot"))
        found = found.join(beside, [*keys, "_part"]).withColumn("_under", F.coalesce("_under", "_before"))
    found = found.withColumn("_knot", F.coalesce("_under", "_least"))
    return found.select(*probes.columns, *[F.col(f"_knot.{c}").alias(c) for c in (name, *also)])


def running(rows: DataFrame, keys: Sequence[str], at: str, count: Column, then: Sequence[str] = (), part_rows: int = PART_ROWS, known: int | None = None) -> DataFrame:
    """Rows with ``_upto``, the sum of ``count`` up to the row in the order of ``at`` and ``then``, and ``_total``, that of its key."""
    parts, several = dealt(rows.withColumn("_count", count), keys, at, part_rows, known)
    upto = F.sum("_count").over(_over(keys, at, *then)).alias("_upto")
    if not several:
        return parts.select(*rows.columns, upto, F.sum("_count").over(Window.partitionBy(*keys, "_part")).alias("_total"))
    w = Window.partitionBy(*keys)
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_count").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_part", before.alias("_before"), F.sum("_sum").over(w).alias("_total"))
    out = parts.select(*rows.columns, "_part", upto).join(sums, [*keys, "_part"])
    return out.select(*rows.columns, (F.col("_upto") + F.col("_before")).alias("_upto"), "_total")


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
