"""Reference model: eligibility, readiness, joint distribution, conditional distribution and density grid.

The joint distribution of a driver x and a response y has the mass of all
pairs (x, y) within a chunk, weighted by the product of their counts. Between
its knots the joint distribution function is bilinear. The condition at a
value of x takes the nearest level of x at or below it, or the lowest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condist.functions.lookup import PART_ROWS, at_or_below, latest, running
from condist.functions.shared import stored
from condist.functions.times import DAY

READY_CHUNKS = 10
READY_DAYS_S = 432_000
READY_SHARE = 0.95


def eligible(override: str = "review_override") -> Column:
    """Chunks that may enter a reference: baseline, good, or bad but accepted by review."""
    accepted = F.col(override).eqNullSafe(True)
    return F.col("state").isin("baseline", "good") | ((F.col("state") == "bad") & accepted)


def ready_by_count(counts: DataFrame, required: int = READY_CHUNKS) -> DataFrame:
    share = F.least(F.col("eligible") / required, F.lit(1.0))
    return counts.withColumns({"coverage": share, "ready": F.col("eligible") >= required})


def ready_by_day(counts: DataFrame, interval_s: str = "interval_s") -> DataFrame:
    """Readiness of time-of-day models: five days of windows, 95 percent of them there."""
    expected = F.ceil(F.lit(READY_DAYS_S) / F.col(interval_s))
    share = F.least(F.col("eligible") / expected, F.lit(1.0))
    return counts.withColumn("expected", expected).withColumn("coverage", share).withColumn("ready", share >= READY_SHARE)


def status(ready: DataFrame, built: DataFrame, keys: list[str]) -> DataFrame:
    """State of each model (``ready`` with coverage, eligible and required): ready or learning, its progress, and when it was last built (``built``: keys, us), if it was."""
    latest_build = built.groupBy(*keys).agg(F.max("us").alias("built_at"))
    state = F.when(F.col("ready"), "ready").otherwise("learning")
    return ready.join(latest_build, keys, "left").select(*keys, state.alias("state"), "coverage", F.col("coverage").alias("progress"), "required", "eligible", "built_at")


def joint_mass(x: DataFrame, y: DataFrame, chunk: list[str], model: list[str]) -> DataFrame:
    """Mass n of each (x, y) of a model, from chunk samples in long form: x with (x, cx), y with (v, c)."""
    pairs = x.join(y, chunk)
    return pairs.groupBy(*model, "x", "v").agg(F.sum(F.col("cx") * F.col("c")).alias("n"))


def joint_cdf(mass: DataFrame, model: list[str]) -> DataFrame:
    """H(x, v) = share of pairs at or under both, on all knots of a model (distinct x by distinct v)."""
    xs, vs = mass.select(*model, "x").distinct(), mass.select(*model, "v").distinct()
    grid = xs.join(vs, model).join(mass, [*model, "x", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = lambda order, *keys: Window.partitionBy(*model, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.withColumn("row", F.sum("n").over(upto("v", "x"))).withColumn("all", F.sum("row").over(upto("x", "v")))
    total = mass.groupBy(*model).agg(F.sum("n").alias("total"))
    return rows.join(total, model).select(*model, "x", "v", (F.col("all") / F.col("total")).alias("h"))


def joint_cdf_at(mass: DataFrame, points: DataFrame, model: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """H(x, v) at asked points (model, x, v) only; points of a model without mass are left out.

    The values v of a model are numbered. The numbers up to a point's are a sum
    of few blocks of numbers whose sizes are powers of two, and within a block
    the masses up to the point's x are a running sum. So a mass and a point
    each become at most as many rows as their numbers have binary digits,
    instead of a row for each pair of knots.
    """
    ranks = running(mass.select(*model, "v").distinct(), model, "v", F.lit(1).cast("long"), part_rows=part_rows)
    ranks = stored(ranks.select(*model, "v", F.col("_upto").alias("rank"), F.col("_total").alias("values")), "ranks")
    # a mass counts in the blocks that a point may ask for: those of even number
    number = F.col("rank") - 1
    digits = F.ceil(F.log2(F.col("values") + 1)).cast("int")
    placed = mass.join(ranks, [*model, "v"]).select(*model, "x", "n", number.alias("_i"), F.explode(F.sequence(F.lit(0), digits)).alias("_b"))
    placed = placed.select(*model, "x", "n", "_b", F.expr("shiftright(_i, _b)").alias("_block")).where("_block % 2 = 0")
    asked = points.select(*model, "x", "v").distinct()
    found = at_or_below(asked, ranks.select(*model, "v", "rank"), model, "v", "_v", part_rows, also=["rank"]).where("_v is not null")
    upto = F.when(F.col("_v") <= F.col("v"), F.col("rank")).otherwise(0)
    found = stored(found.select(*model, "x", "v", upto.alias("_r")), "asked")
    blocks = found.where("_r > 0").withColumn("_b", F.explode(F.expr("filter(sequence(0, cast(log2(_r) as int)), b -> shiftright(_r, b) % 2 = 1)")))
    blocks = blocks.select(*model, "x", "v", "_b", F.expr("shiftright(_r, _b) - 1").alias("_block"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("_order"))
    both = stored(placed.withColumn("_order", F.lit(0)).unionByName(blocks, allowMissingColumns=True), "blocks")
    sums = running(both, [*model, "_b", "_block"], "x", F.col("n"), ["_order"], part_rows).where("_order = 1")
    sums = sums.groupBy(*model, "x", "v").agg(F.sum("_upto").alias("_h"))
    total = mass.groupBy(*model).agg(F.sum("n").alias("_all"))
    return found.join(sums, [*model, "x", "v"], "left").join(total, model).select(*model, "x", "v", (F.coalesce("_h", F.lit(0)) / F.col("_all")).alias("h"))


def conditional_points(mass: DataFrame, model: list[str], known: int | None = None) -> DataFrame:
    """Distribution function (v, p) of y at each level x; ``known`` is a bound on the rows of any level, if there is one."""
    upto = running(mass.select(*model, "x", "v", "n"), [*model, "x"], "v", F.col("n"), known=known)
    return upto.select(*model, "x", "v", (F.col("_upto") / F.col("_total")).alias("p"))


def validate_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a distribution function is sorted in both columns and within [0, 1], and how many points it has."""
    w = Window.partitionBy(*keys).orderBy("v")
    rows = points.withColumn("bad", (F.col("p") < 0) | (F.col("p") > 1) | (F.coalesce(F.lag("p").over(w), F.lit(0.0)) > F.col("p")))
    return rows.groupBy(*keys).agg(F.count("*").alias("points"), (~F.bool_or("bad")).alias("valid"))


def near_least(rows: DataFrame, keys: list[str], ulps: int = 5, by: tuple[str, ...] = (), sums: bool = False) -> tuple[DataFrame, bool]:
    """Rows (a stored table) with ``least``, and whether any value may not be its own.

    ``least`` is the least value of v's group, where neighbours within ``ulps``
    units in the last place are one group. With ``sums``, rows of the same keys,
    ``by`` and v are first added up (n), in the same shuffle. Values are ordered within sixteenths
    of octaves, so a service with very many values is no single task. A group
    reaches over two of them only
    with a value so near its sixteenth's lower end that a step down leaves it.
    If there is any, a sixteenth is summed up by its first value, its last, and
    where its last group starts; a scan over these tells which go on with a
    group from below, and only their rows are looked up again.
    """
    v = F.col("v")

    def sixteenth(at: Column) -> Column:
        # ends are moved off the powers of two, and zero has its neighbours in its own part
        octave = F.floor(F.log2(F.abs(at)) * 16 + 0.37) + 20_000
        return F.when(at > 1e-300, octave).when(at < -1e-300, -octave).otherwise(0)

    rows = rows.withColumn("_o", sixteenth(v)).repartition(*keys, "_o")
    if sums:
        rows = rows.groupBy(*keys, "_o", *by, "v").agg(F.sum("n").alias("n"))
    inside, before = Window.partitionBy(*keys, "_o").orderBy("v"), Window.partitionBy(*keys).orderBy("_o")
    step = lambda at: ulps * F.when(at == 0, 4.9e-324).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(at))) - 52))
    gap = v - F.lag("v").over(inside)
    marked = rows.withColumn("_s", F.when(gap.isNull() | (gap > step(v)), v))
    own = marked.withColumn("least", F.last("_s", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    own = stored(own.drop("_s"), "ordered")
    near, over = F.bool_or(F.col("least") != v), F.bool_or(sixteenth(v - step(v)) != F.col("_o"))
    found = own.agg(near, over).first()
    if not found[1]:
        return own.drop("_o"), bool(found[0])
    parts = own.groupBy(*keys, "_o").agg(F.min("v").alias("_first"), F.max("v").alias("_last"), F.max("least").alias("_start"))
    joins = F.coalesce(F.col("_first") - F.lag("_last").over(before) <= step(F.col("_first")), F.lit(False))
    parts = parts.withColumn("_joins", joins)
    # where the last group of a sixteenth starts, unless it is all of it and goes on from below
    known = F.when(~(F.col("_joins") & (F.col("_start") == F.col("_first"))), F.col("_start"))
    parts = parts.withColumn("_below", F.last(known, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    going_on = parts.where("_joins").select(*keys, "_o", "_first", "_below")
    out = own.join(going_on, [*keys, "_o"], "left")
    return out.withColumn("least", F.when(F.col("least") == F.col("_first"), F.col("_below")).otherwise(F.col("least"))).drop("_o", "_first", "_below"), True


def coalesce_near(values: DataFrame, keys: list[str], ulps: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of n over groups of near values of a key (see ``near_least``), each with its least value; apart for each of ``by``.

    Where no values are near, the sums by value are the result: a stored table.
    """
    rows, near = near_least(values.select(*keys, *by, "v", "n"), keys, ulps, by, sums=True)
    if not near:
        return rows.drop("least")
    return stored(rows.groupBy(*keys, *by, F.col("least").alias("v")).agg(F.sum("n").alias("n")), "coalesced")


def density_grid(mass: DataFrame, model: list[str], width: int, height: int, log_x: bool = False, log_y: bool = False) -> DataFrame:
    """Mass of each cell of a grid over a model's range: row (0 at the largest v), col (0 at the least x), mass.

    The distribution function is bilinear between knots, so the mass of a knot
    lies evenly between it and the knots before it; mass at the least x or
    least v lies on the grid's edge and outside its cells. Cells without mass
    are not returned, nor is a model with values of zero or less on a
    logarithmic axis.
    """
    if width < 2 or height < 2:
        raise ValueError("a grid has two columns and rows at least")
    n_total = mass.groupBy(*model).agg(F.sum("n").alias("total"))

    def edges(column: str, cells: int, log: bool) -> DataFrame:
        """Share of each knot's interval in each cell."""
        w = Window.partitionBy(*model).orderBy(column)
        knots = mass.select(*model, column).distinct().withColumn("before", F.lag(column).over(w))
        bounds = mass.groupBy(*model).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("hi > lo and lo > 0" if log else "hi > lo")
        k = knots.where("before is not null").join(bounds, model)
        ratio = (lambda c: F.log(c / F.col("lo")) / F.log(F.col("hi") / F.col("lo"))) if log else (lambda c: (c - F.col("lo")) / (F.col("hi") - F.col("lo")))
        edge = (lambda i: F.col("lo") * F.exp(i / cells * F.log(F.col("hi") / F.col("lo")))) if log else (lambda i: F.col("lo") + i / cells * (F.col("hi") - F.col("lo")))
        first = F.greatest(F.floor(ratio(F.col("before")) * cells) - 1, F.lit(0))
        last = F.least(F.floor(ratio(F.col(column)) * cells) + 1, F.lit(cells - 1))
        k = k.withColumn("cell", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        a = F.greatest(edge(F.col("cell").cast("double")), F.col("before"))
        b = F.least(edge(F.col("cell").cast("double") + 1), F.col(column))
        return k.withColumn("share", (b - a) / (F.col(column) - F.col("before"))).where("share > 0").select(*model, column, "cell", "share")

    ex = edges("x", width, log_x).withColumnsRenamed({"cell": "col", "share": "share_x"})
    ey = edges("v", height, log_y).withColumnsRenamed({"cell": "line", "share": "share_y"})
    # one axis at a time, with a sum between: a cell column has few rows by then
    by_col = mass.join(ex, [*model, "x"]).groupBy(*model, "col", "v").agg(F.sum(F.col("n") * F.col("share_x")).alias("_m"))
    cells = by_col.join(ey, [*model, "v"]).groupBy(*model, "col", "line").agg(F.sum(F.col("_m") * F.col("share_y")).alias("_m"))
    return cells.join(n_total, model).select(*model, (height - 1 - F.col("line")).alias("row"), "col", (F.col("_m") / F.col("total")).alias("mass"))


def normalised(grid: DataFrame, model: list[str], gamma: float = 0.55) -> DataFrame:
    """Masses over the model's largest, to the power ``gamma``; zeros if all are zero."""
    top = F.max("mass").over(Window.partitionBy(*model))
    return grid.withColumn("level", F.when(top > 0, F.pow(F.col("mass") / top, F.lit(gamma))).otherwise(0.0))


def versions(publications: DataFrame, keys: list[str], stretch: int = 30 * DAY) -> DataFrame:
    """Publications numbered by interval_end within their key; one for each interval_end (the first by id), none without a body.

    Numbers are counts over bounded stretches of time and then over the stretches.
    """
    once = latest(publications.where(F.length("body") > 0), [*keys, "interval_end"], F.col("id"))
    rows = once.withColumn("_s", F.floor(F.col("interval_end") / stretch))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_s").agg(F.count("*").alias("_t")).withColumn("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("interval_end"))
    return rows.withColumn("_n", own).join(totals, [*keys, "_s"]).withColumn("version", F.col("_n") + F.col("_b")).drop("_s", "_t", "_b", "_n")


def scan(verdicts: DataFrame, services: DataFrame) -> DataFrame:
    """Eligible chunks of each service's active generation, in order of time."""
    active = services.select("service", "generation")
    return verdicts.where(eligible()).join(active, ["service", "generation"], "left_semi").orderBy("us", "id")


def publish(mass: DataFrame, ready: DataFrame, now: DataFrame, model: list[str]) -> DataFrame:
    """Models that may be published: ready, and of a service (generation in ``ready``) whose generation is still that in ``now``."""
    same = ready.where("ready").join(now.select("service", "generation"), ["service", "generation"], "left_semi")
    return mass.join(same.select(*model, "generation"), model)


def retained(numbered: DataFrame, keys: list[str], keep: int = 5) -> DataFrame:
    """The ``keep`` newest versions of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return numbered.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def current(kept: DataFrame, keys: list[str]) -> DataFrame:
    """The newest kept version whose body has its length and checksum."""
    whole = (F.length("body") == F.col("bytes")) & (F.sha2(F.col("body"), 256) == F.col("checksum"))
    return kept.where(whole).groupBy(*keys).agg(F.max_by("version", "version").alias("version"), F.max_by("body", "version").alias("body"))
