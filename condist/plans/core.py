"""Queries of sources, windows, samples, model and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condist.functions.shared import shared_folder
from condist.functions.stats import kolmogorov_p, significant
from condist.functions.times import HOUR, micros, moment
from condist.operators import model, samples, scoring, services, upsert, windows
from condist.plans import views as v
from condist.plans.registry import query
from condist.sources import metrics

E = SparkSession
RANGE_START, RANGE_END = 1_704_067_200_000_000, 1_706_659_200_000_000
r9 = lambda c: F.round(c, 9)


# --- sources -----------------------------------------------------------------------------------------------------


@query(
    """SELECT service, w, CAST((us // 1000000) - ((us // 1000000) % 60) AS DOUBLE) AS ts_s, round(max(value), 9) AS value
FROM win WHERE ((us // 1000000) - ((us // 1000000) % 60)) * 1000000 > w - 21600000000 GROUP BY ALL"""
)
def range_matrix_load(spark: E, d: str) -> DataFrame:
    """Exported range responses of each service and window (a point a minute), loaded from their files; broken ones are left out."""
    return loaded(metrics.exports(spark, exported(spark, d), "service string"))


def exported(spark: E, d: str) -> str:
    """A folder of exports by service: a document for each window, and three of each service that cannot be used."""
    minute = F.expr("us div 1000000 div 60 * 60")
    points = v.win(spark, d).groupBy("service", "w", minute.alias("m")).agg(F.max("value").alias("value"))
    pair = F.array(F.col("m").cast("string"), F.col("value").cast("string"))
    bodies = points.groupBy("service", "w").agg(F.collect_list(pair).alias("values"))
    result = F.array(F.struct(F.create_map(F.lit("job"), F.col("service")).alias("metric"), "values"))
    iso = lambda us: F.date_format(moment(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def document(status: Column, kind: Column) -> Column:
        body = F.struct(F.lit("success").alias("status"), F.struct(kind.alias("resultType"), result.alias("result")).alias("data"))
        return F.to_json(F.struct(F.lit("rate(requests[1m])").alias("query"), iso(f"w - {v.WINDOW}").alias("start"), iso("w").alias("end"), F.lit(60).alias("step_seconds"), status.alias("status_code"), body.alias("response_body")))

    good = bodies.select("service", document(F.lit(200), F.lit("matrix")).alias("value"))
    one = bodies.groupBy("service").agg(F.min_by("values", "w").alias("values"), F.min("w").alias("w"))
    bad = [document(F.lit(500), F.lit("matrix")), document(F.lit(200), F.lit("vector")), F.substring(document(F.lit(200), F.lit("matrix")), 1, 90)]
    path = shared_folder(spark, "exports")
    good.unionByName(one.select("service", F.explode(F.array(*bad)).alias("value"))).write.partitionBy("service").text(path)
    return path


def loaded(found: DataFrame) -> DataFrame:
    points = metrics.range_matrix(found.where("problem is null").drop("problem"))
    seconds = points.withColumn("start_s", F.col("start_us") / 1_000_000).withColumn("end_s", F.col("end_us") / 1_000_000)
    return metrics.after_start(seconds).select("service", F.col("end_us").alias("w"), "ts_s", r9("value").alias("value"))


@query("SELECT service, p AS problem, CAST(1 AS BIGINT) AS documents FROM (SELECT DISTINCT service FROM obs), (VALUES ('not JSON'), ('status 500'), ('expected a matrix, got vector')) t(p)")
def response_problems(spark: E, d: str) -> DataFrame:
    """What is wrong with exports that cannot be used."""
    found = metrics.exports(spark, exported(spark, d), "service string").where("problem is not null")
    return found.groupBy("service", "problem").agg(F.count("*").alias("documents"))


@query(
    """SELECT series, ts_s, upper, count FROM (SELECT l_returnflag AS series, CAST(12 * year(l_shipdate) + month(l_shipdate) AS DOUBLE) AS ts_s,
  CASE WHEN l_quantity > 40 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(ceil(l_quantity / 10) * 10 AS DOUBLE) END AS upper, CAST(floor(sum(l_linenumber) / 4 + 0.5) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2, 3)"""
)
def histogram_responses(spark: E, d: str) -> DataFrame:
    """Native histograms of exported responses, one response a series, with the buckets of each month."""
    i = v.table(spark, d, "lineitem").withColumn("m", F.expr("12 * year(l_shipdate) + month(l_shipdate)"))
    upper = F.when(F.col("l_quantity") > 40, "+Inf").otherwise((F.ceil(F.col("l_quantity") / 10) * 10).cast("string"))
    counts = i.groupBy(F.col("l_returnflag").alias("series"), "m", upper.alias("upper")).agg((F.sum("l_linenumber") / 4).cast("string").alias("n"))
    bucket = F.to_json(F.array(F.lit("0"), F.lit("0"), "upper", "n"))
    scrapes = counts.groupBy("series", "m").agg(F.concat(F.lit("["), F.col("m").cast("string"), F.lit(',{"count":"1","sum":"1","buckets":['), F.array_join(F.collect_list(bucket), ","), F.lit("]}]")).alias("h"))
    body = F.concat(F.lit('{"status_code":200,"response_body":{"status":"success","data":{"resultType":"matrix","result":[{"histograms":['), F.array_join(F.collect_list("h"), ","), F.lit("]}]}}}"))
    path = shared_folder(spark, "histograms")
    scrapes.groupBy(F.col("series").alias("name")).agg(body.alias("value")).write.partitionBy("name").text(path)
    found = metrics.exports(spark, path, "name string").where("problem is null").select("name", "response")
    return metrics.histogram_points(found).select(F.col("name").alias("series"), "ts_s", "upper", "count")


SCRAPES = "strftime(l_shipdate, '%Y-%m')"


def bucket_rows(spark: E, d: str) -> DataFrame:
    i = v.table(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    upper = (F.ceil(F.col("l_quantity") / 10) * 10).cast("double").cast("string")
    return i.groupBy(F.col("l_returnflag").alias("series"), "month", upper.alias("upper")).agg((F.sum("l_linenumber") / 4).cast("string").alias("count"))


@query(
    f"""SELECT l_returnflag AS series, {SCRAPES} AS month, CAST(ceil(l_quantity / 10) * 10 AS DOUBLE) AS upper,
  CAST(floor(sum(l_linenumber) / 4 + 0.5) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2, 3"""
)
def histogram_load(spark: E, d: str) -> DataFrame:
    return metrics.histogram_buckets(bucket_rows(spark, d)).select("series", "month", "upper", "count")


@query("SELECT event_id, w FROM win")
def window_assign(spark: E, d: str) -> DataFrame:
    return v.win(spark, d).select("event_id", "w")


@query(
    """SELECT w, count(DISTINCT service) AS series, CASE WHEN count(DISTINCT service) = 1 THEN 'ok' ELSE 'several series' END AS status
FROM attempts GROUP BY w"""
)
def series_check(spark: E, d: str) -> DataFrame:
    return metrics.series_check(windows.assign(v.obs(spark, d), HOUR), ["w"], "user_id")


VALUES = "CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 89 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END"


@query(f"SELECT service, w, count(*) AS samples, count(*) FILTER (NOT isfinite({VALUES})) AS invalid, count(*) FILTER (NOT isfinite({VALUES})) = 0 AS valid FROM win GROUP BY service, w")
def finite_check(spark: E, d: str) -> DataFrame:
    return metrics.finite_check(v.win(spark, d).withColumn("value", F.expr(VALUES)), v.KEY)


PROBE_END = RANGE_START + 20 * 24 * HOUR


@query(f"SELECT service, count(*) AS samples, round(max(value), 9) AS latest, true AS valid FROM obs WHERE us > {PROBE_END} - 18000000000 AND us <= {PROBE_END} GROUP BY service")
def source_probe(spark: E, d: str) -> DataFrame:
    return metrics.probe(v.obs(spark, d), "service", PROBE_END, 300).withColumn("latest", r9("latest"))


WRITE_KEY = ["service", "kind"]


def chunk_writes(spark: E, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("service"), F.col("o_orderpriority").alias("kind"), F.expr("o_orderkey % 3").alias("generation"), micros("o_orderdate").alias("collected_at"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("body"))


WRITES = "SELECT o_custkey AS service, o_orderpriority AS kind, o_orderkey % 3 AS generation, epoch_us(o_orderdate) AS collected_at, o_orderkey AS id, o_totalprice AS body FROM orders"
STANDING = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service, kind ORDER BY generation DESC, collected_at DESC, id DESC) AS k FROM ({WRITES})) WHERE k = 1"


@query(f"SELECT service, kind, generation, collected_at, id, body FROM ({STANDING})")
def chunk_upsert(spark: E, d: str) -> DataFrame:
    return upsert.chunk_upsert(chunk_writes(spark, d), WRITE_KEY)


@query(f"SELECT c.service, c.kind, c.generation, c.body FROM ({STANDING}) c WHERE EXISTS (SELECT 1 FROM ({WRITES}) w WHERE w.service = c.service AND w.kind = c.kind AND w.generation = 2)")
def chunk_read(spark: E, d: str) -> DataFrame:
    """The standing chunks of all keys that had a write of generation two, each by its key."""
    writes = chunk_writes(spark, d)
    wanted = writes.where("generation = 2").select(*WRITE_KEY).distinct()
    return upsert.read_chunks(upsert.chunk_upsert(writes, WRITE_KEY), wanted, WRITE_KEY).select(*WRITE_KEY, "generation", "body")


# --- windows -----------------------------------------------------------------------------------------------------


def plan(spark: E, d: str) -> DataFrame:
    ranges = v.obs(spark, d).select("service").distinct().withColumn("start_us", F.lit(RANGE_START)).withColumn("end_us", F.lit(RANGE_END - 30 * 60_000_000))
    return windows.plan(ranges, HOUR)


PLAN = f"""SELECT service, n, {RANGE_START} + n * {HOUR} AS w_start, least({RANGE_START} + (n + 1) * {HOUR}, {RANGE_END} - 1800000000) AS w_end,
  least(CAST({HOUR} AS BIGINT), {RANGE_END} - 1800000000 - {RANGE_START} - n * {HOUR}) / 1000000 AS step_s
FROM (SELECT DISTINCT service FROM obs), generate_series(0, 719) g(n)"""


@query(PLAN)
def plan_windows(spark: E, d: str) -> DataFrame:
    return plan(spark, d).select("service", "n", "w_start", "w_end", "step_s")


def collected(spark: E, d: str) -> DataFrame:
    return windows.assign(v.obs(spark, d), HOUR).select("service", F.col("w").alias("w_end"))


HAVE = f"SELECT DISTINCT service, ((us + {HOUR} - 1) // {HOUR}) * {HOUR} AS w_end FROM obs"


@query(f"SELECT service, n, w_end FROM ({PLAN}) p WHERE NOT EXISTS (SELECT 1 FROM ({HAVE}) h WHERE h.service = p.service AND h.w_end = p.w_end)")
def monitoring_gaps(spark: E, d: str) -> DataFrame:
    return windows.gaps(plan(spark, d), collected(spark, d), ["service", "w_end"]).select("service", "n", "w_end")


SUMMARY = f"""SELECT p.service, count(*) AS total, count(h.service) AS imported, count(*) - count(h.service) AS gaps,
  CAST(floor(100 * (max(CASE WHEN h.service IS NOT NULL THEN p.w_end END) - {RANGE_START}) / ({RANGE_END} - 1800000000 - {RANGE_START})) AS BIGINT) AS percent
FROM ({PLAN}) p LEFT JOIN ({HAVE}) h ON h.service = p.service AND h.w_end = p.w_end GROUP BY p.service"""


@query(SUMMARY)
def import_summary(spark: E, d: str) -> DataFrame:
    return windows.import_summary(plan(spark, d), collected(spark, d), ["service", "w_end"])


@query(
    f"""SELECT *, CASE WHEN starts_with(state, 'complete') THEN 100 ELSE percent END AS progress
FROM (SELECT *, CASE WHEN imported = 0 THEN 'failed' WHEN gaps > 0 THEN 'complete_with_gaps' ELSE 'complete' END AS state FROM ({SUMMARY}))"""
)
def import_job_state(spark: E, d: str) -> DataFrame:
    return windows.completion(import_summary(spark, d))


@query(
    """SELECT id, CAST(n AS BIGINT) AS n, at_s + n * cap AS w_start, least(at_s + (n + 1) * cap, boundary) AS w_end
FROM (SELECT *, greatest(old_s, new_s) AS cap, ((at_s + new_s - 1) // new_s) * new_s AS boundary
  FROM (SELECT service, id, at_s + 7 * (id % 13) AS at_s, interval_s AS new_s, lag(interval_s) OVER (PARTITION BY service ORDER BY at_s, id) AS old_s FROM revisions)
  WHERE old_s IS NOT NULL AND old_s <> new_s), generate_series(0, 3) g(n)
WHERE at_s + n * cap < boundary"""
)
def transition_windows(spark: E, d: str) -> DataFrame:
    changes = windows.revisions(v.revisions(spark, d), "service", ["at_s", "id"]).withColumn("at", F.expr("at_s + 7 * (id % 13)"))
    return windows.transitions(changes.select("id", "at", "old_s", "new_s")).select("id", "n", "w_start", "w_end")


# --- samples -----------------------------------------------------------------------------------------------------


@query("SELECT service, w, round(v, 9) AS v, c FROM ys")
def count_samples(spark: E, d: str) -> DataFrame:
    return v.ys(spark, d).withColumn("v", r9("v"))


def cumulative(spark: E, d: str) -> DataFrame:
    """Scrapes of cumulative counts by bucket that start anew every twelve."""
    i = v.table(spark, d, "lineitem").withColumn("seq", F.expr("12 * year(l_shipdate) + month(l_shipdate)").cast("long"))
    upper = F.when(F.col("l_quantity") > 40, float("inf")).otherwise(F.ceil(F.col("l_quantity") / 10) * 10).cast("double")
    counts = i.groupBy(F.col("l_returnflag").alias("series"), "seq", upper.alias("upper")).agg(F.count("*").alias("new"))
    w = Window.partitionBy("series", "upper", F.expr("seq div 12")).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("series", "seq", "upper", F.sum("new").over(w).alias("count"))


@query(
    """SELECT series, upper, CAST(sum(greatest(count - p, 0)) AS BIGINT) AS increase
FROM (SELECT *, lag(count) OVER b AS p, lag(seq) OVER b AS ps FROM (
    SELECT series, seq, upper, sum(n) OVER (PARTITION BY series, upper, seq // 12 ORDER BY seq) AS count FROM (
      SELECT l_returnflag AS series, CAST(12 * year(l_shipdate) + month(l_shipdate) AS BIGINT) AS seq,
        CASE WHEN l_quantity > 40 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(ceil(l_quantity / 10) * 10 AS DOUBLE) END AS upper, count(*) AS n
      FROM lineitem GROUP BY 1, 2, 3))
  WINDOW b AS (PARTITION BY series, upper ORDER BY seq))
WHERE ps = seq - 1 AND upper < CAST('Infinity' AS DOUBLE) GROUP BY series, upper HAVING sum(greatest(count - p, 0)) > 0"""
)
def histogram_increase(spark: E, d: str) -> DataFrame:
    return samples.histogram_increase(cumulative(spark, d), ["series"])


@query(
    """SELECT service, w, xs.x AS load, y.entries, y.total, y.first, y.last FROM xs JOIN (
  SELECT service, w, count(*) AS entries, CAST(sum(c) AS BIGINT) AS total, round(min(v), 9) AS first, round(max(v), 9) AS last FROM ys GROUP BY service, w) y USING (service, w)"""
)
def load_latency_chunks(spark: E, d: str) -> DataFrame:
    x = v.xs(spark, d).select("service", "w", F.col("x").alias("v"), F.lit(1).cast("long").alias("c"))
    chunks = samples.load_latency(x, v.ys(spark, d), v.KEY)
    total = F.aggregate("y.c", F.lit(0).cast("long"), lambda a, b: a + b)
    return chunks.select("service", "w", F.col("x")[0]["v"].alias("load"), F.size("y").cast("long").alias("entries"), total.alias("total"), r9(F.col("y")[0]["v"]).alias("first"), r9(F.element_at("y.v", -1)).alias("last"))


@query("SELECT service, w, (w // 1000000) % 86400 AS second_of_day, CAST(1 AS BIGINT) AS c, x AS load FROM xs")
def time_of_day_chunks(spark: E, d: str) -> DataFrame:
    return v.xs(spark, d).select("service", "w", samples.time_of_day("w").alias("second_of_day"), F.lit(1).cast("long").alias("c"), F.col("x").alias("load"))


@query("SELECT service, w, round(sum(v * c) / sum(c), 9) AS mean FROM ys GROUP BY service, w")
def weighted_mean(spark: E, d: str) -> DataFrame:
    return v.ys(spark, d).groupBy(*v.KEY).agg(r9(samples.weighted_mean()).alias("mean"))


DAYS = "w // 86400000000"


@query(
    f"""SELECT service, {DAYS} AS day, CASE WHEN bool_or(c <= 0) THEN 'zero count' END AS problem,
  CASE WHEN NOT bool_or(c <= 0) THEN round(sum(v * c) / sum(c), 9) END AS mean
FROM (SELECT service, w, v, CASE WHEN (w // 21600000000) % 40 = 0 AND v > 40 THEN 0 ELSE c END AS c FROM ys) GROUP BY 1, 2"""
)
def weighted_average_multi(spark: E, d: str) -> DataFrame:
    y = v.ys(spark, d).withColumn("c", F.expr("case when (w div 21600000000) % 40 = 0 and v > 40 then 0L else c end"))
    out = samples.checked_mean(y.withColumn("day", F.expr("w div 86400000000")), ["service", "day"])
    return out.withColumn("mean", r9("mean"))


@query(f"SELECT service, {DAYS} AS day, round(v, 9) AS v, CAST(sum(c) AS BIGINT) AS c FROM ys GROUP BY 1, 2, v")
def merge_samples(spark: E, d: str) -> DataFrame:
    y = v.ys(spark, d).withColumn("day", F.expr("w div 86400000000"))
    return samples.merge(y, ["service", "day"]).withColumn("v", r9("v"))


@query("SELECT service, w, CAST(sum(c) AS BIGINT) AS total, count(*) AS entries, count(*) FILTER (c > 0) AS nonempty, sum(c) > 0 AS valid FROM ys GROUP BY service, w")
def sample_totals(spark: E, d: str) -> DataFrame:
    return samples.totals(v.ys(spark, d), v.KEY)


# --- model -------------------------------------------------------------------------------------------------------


@query("SELECT id, service, indicator, us FROM eligible WHERE generation = CASE WHEN service < '3' THEN 1 ELSE 2 END ORDER BY us, id")
def eligible_chunks(spark: E, d: str) -> DataFrame:
    """Eligible chunks of the active generations, in order of time."""
    return model.scan(v.verdicts(spark, d), v.monitored(spark, d)).select("id", "service", "indicator", "us")


def eligible_counts(spark: E, d: str) -> DataFrame:
    return v.verdicts(spark, d).where(model.eligible()).groupBy("service", "indicator").agg(F.count("*").alias("eligible"))


ELIGIBLE = "SELECT service, indicator, count(*) AS eligible FROM eligible GROUP BY service, indicator"


@query(ELIGIBLE)
def eligible_count(spark: E, d: str) -> DataFrame:
    return eligible_counts(spark, d)


@query(f"SELECT service, indicator, eligible, round(least(eligible / 1100, 1.0), 9) AS coverage, eligible >= 1100 AS ready FROM ({ELIGIBLE})")
def readiness_load_latency(spark: E, d: str) -> DataFrame:
    return model.ready_by_count(eligible_counts(spark, d), 1100).withColumn("coverage", r9("coverage"))


@query(
    f"""SELECT service, indicator, eligible, interval_s, CAST(ceil(432000.0 / interval_s) AS BIGINT) AS expected,
  round(least(eligible / ceil(432000.0 / interval_s), 1.0), 9) AS coverage, least(eligible / ceil(432000.0 / interval_s), 1.0) >= 0.95 AS ready
FROM (SELECT *, CAST(120 * (1 + length(service) % 4) AS BIGINT) AS interval_s FROM ({ELIGIBLE}))"""
)
def readiness_time_of_day(spark: E, d: str) -> DataFrame:
    counts = eligible_counts(spark, d).withColumn("interval_s", F.expr("120 * (1 + length(service) % 4)").cast("long"))
    return model.ready_by_day(counts).withColumn("coverage", r9("coverage"))


@query("SELECT service, x, round(v, 9) AS v, n FROM mass")
def joint_mass(spark: E, d: str) -> DataFrame:
    """Joint mass of load and response; a window has one load, so its pairs come from its samples in one pass."""
    return v.published(spark, d).select("service", "x", r9("v").alias("v"), "n")


@query("SELECT service, x, v, n FROM tmass")
def time_of_day_mass(spark: E, d: str) -> DataFrame:
    """Joint mass of second of day and hourly load."""
    return v.tod_mass(spark, d)


@query(
    """SELECT service, x, round(v, 9) AS v, round(upto / total, 9) AS h FROM (
  SELECT service, x, v, total, sum(run) OVER (PARTITION BY service, v ORDER BY x) AS upto FROM (
    SELECT gx.service, gx.x, gv.v, t.total, sum(coalesce(m.n, 0)) OVER (PARTITION BY gx.service, gx.x ORDER BY gv.v) AS run
    FROM (SELECT DISTINCT service, x FROM mass) gx JOIN (SELECT DISTINCT service, v FROM mass) gv ON gx.service = gv.service
    JOIN (SELECT service, sum(n) AS total FROM mass GROUP BY service) t ON t.service = gx.service
    LEFT JOIN mass m ON m.service = gx.service AND m.x = gx.x AND m.v = gv.v))"""
)
def joint_ecdf(spark: E, d: str) -> DataFrame:
    return model.joint_cdf(v.published(spark, d), v.MODEL).select("service", "x", r9("v").alias("v"), r9("h").alias("h"))


@query(
    """SELECT service, x, round(v, 9) AS v, round(upto / total, 9) AS h FROM (
  SELECT service, x, v, total, n, sum(run) OVER (PARTITION BY service, v ORDER BY x) AS upto FROM (
    SELECT gx.service, gx.x, gv.v, t.total, m.n, sum(coalesce(m.n, 0)) OVER (PARTITION BY gx.service, gx.x ORDER BY gv.v) AS run
    FROM (SELECT DISTINCT service, x FROM mass) gx JOIN (SELECT DISTINCT service, v FROM mass) gv ON gx.service = gv.service
    JOIN (SELECT service, sum(n) AS total FROM mass GROUP BY service) t ON t.service = gx.service
    LEFT JOIN mass m ON m.service = gx.service AND m.x = gx.x AND m.v = gv.v)) WHERE n IS NOT NULL"""
)
def joint_ecdf_points(spark: E, d: str) -> DataFrame:
    """The joint distribution function at the pairs that have mass, without the grid of all knots."""
    m = v.published(spark, d)
    return model.joint_cdf_at(m, m, v.MODEL).select("service", "x", r9("v").alias("v"), r9("h").alias("h"))


@query("SELECT service, x, round(v, 9) AS v, round(p, 9) AS p FROM points")
def conditional_cdf(spark: E, d: str) -> DataFrame:
    return model.conditional_points(v.published(spark, d), v.MODEL).select("service", "x", r9("v").alias("v"), r9("p").alias("p"))


@query("SELECT service, x, count(*) AS points, bool_and(p >= 0 AND p <= 1) AS valid FROM points GROUP BY service, x")
def cdf_validate(spark: E, d: str) -> DataFrame:
    return model.validate_points(model.conditional_points(v.published(spark, d), v.MODEL), ["service", "x"])


NEAR = "v * (1 + CASE WHEN n % 2 = 0 THEN 2.220446049250313e-16 ELSE 0 END)"


@query(
    """SELECT service, round(min(v), 9) AS v, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT *, sum(CASE WHEN v - p > 5 * CASE WHEN v = 0 THEN 4.9e-324 ELSE pow(2, floor(log2(abs(v))) - 52) END THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY v ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(v) OVER (PARTITION BY service ORDER BY v) AS p FROM (
    SELECT service, v * (1 + CASE WHEN x % 2 = 0 THEN 2.220446049250313e-16 ELSE 0 END) AS v, sum(n) AS n FROM mass GROUP BY 1, 2)))
GROUP BY service, g"""
)
def ulp_coalesce(spark: E, d: str) -> DataFrame:
    """Response values, those of even loads shifted by one unit in the last place, brought together again."""
    shifted = F.col("v") * (1 + F.when(F.col("x") % 2 == 0, 2.220446049250313e-16).otherwise(0.0))
    values = v.mass(spark, d).groupBy("service", shifted.alias("v")).agg(F.sum("n").alias("n"))
    return model.coalesce_near(values, v.MODEL).withColumn("v", r9("v"))


def grid(spark: E, d: str) -> DataFrame:
    return model.density_grid(v.published(spark, d), v.MODEL, 128, 128, log_y=True)


GRID = """
SELECT k.service, CAST(127 - j.line AS BIGINT) AS row, CAST(i.col AS INTEGER) AS col, sum(k.n * i.share * j.share / t.total) AS mass
FROM mass k
JOIN (SELECT service, sum(n) AS total FROM mass GROUP BY service) t USING (service)
JOIN (SELECT service, x, col, (least(lo + (col + 1) / 128 * (hi - lo), x) - greatest(lo + col / 128 * (hi - lo), b)) / (x - b) AS share
  FROM (SELECT service, x, lag(x) OVER (PARTITION BY service ORDER BY x) AS b, min(x) OVER (PARTITION BY service) AS lo, max(x) OVER (PARTITION BY service) AS hi
    FROM (SELECT DISTINCT service, x FROM mass)), generate_series(0, 127) g(col) WHERE b IS NOT NULL) i ON i.service = k.service AND i.x = k.x AND i.share > 0
JOIN (SELECT service, v, line, (least(lo * exp((line + 1) / 128 * ln(hi / lo)), v) - greatest(lo * exp(line / 128 * ln(hi / lo)), b)) / (v - b) AS share
  FROM (SELECT service, v, lag(v) OVER (PARTITION BY service ORDER BY v) AS b, min(v) OVER (PARTITION BY service) AS lo, max(v) OVER (PARTITION BY service) AS hi
    FROM (SELECT DISTINCT service, v FROM mass)), generate_series(0, 127) g(line) WHERE b IS NOT NULL AND lo > 0) j ON j.service = k.service AND j.v = k.v AND j.share > 0
GROUP BY 1, 2, 3"""


@query(f"SELECT service, row, col, round(mass, 9) AS mass FROM ({GRID})")
def density_grid(spark: E, d: str) -> DataFrame:
    return grid(spark, d).select("service", F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), r9("mass").alias("mass"))


@query(f"SELECT service, row, col, round(pow(mass / max(mass) OVER (PARTITION BY service), 0.55), 6) AS level FROM ({GRID})")
def normalize_masses(spark: E, d: str) -> DataFrame:
    levels = model.normalised(grid(spark, d), v.MODEL)
    return levels.select("service", F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), F.round("level", 6).alias("level"))


@query("SELECT service, indicator, interval_end, id, version FROM versions")
def model_versions(spark: E, d: str) -> DataFrame:
    out = model.versions(v.publications(spark, d), ["service", "indicator"])
    return out.select("service", "indicator", "interval_end", "id", F.col("version").cast("long").alias("version"))


@query("SELECT service, indicator, id, version FROM kept")
def version_retention(spark: E, d: str) -> DataFrame:
    kept = model.retained(model.versions(v.publications(spark, d), ["service", "indicator"]), ["service", "indicator"])
    return kept.select("service", "indicator", "id", F.col("version").cast("long").alias("version"))


CURRENT = "SELECT service, indicator, max(version) AS version, arg_max(body, version) AS body FROM kept WHERE length(body) = bytes AND sha256(body) = checksum GROUP BY service, indicator"


@query(CURRENT)
def current_model(spark: E, d: str) -> DataFrame:
    keys = ["service", "indicator"]
    found = model.current(model.retained(model.versions(v.publications(spark, d), keys), keys), keys)
    return found.select(*keys, F.col("version").cast("long").alias("version"), F.col("body").cast("string").alias("body"))


READY = f"SELECT service, indicator FROM ({ELIGIBLE}) WHERE eligible >= 1100"


GENERATION = "length(service) % 3"


@query(
    f"""SELECT m.indicator, m.service, m.x, round(m.v, 9) AS v, m.n, CAST({GENERATION} AS INTEGER) AS generation
FROM (SELECT 1 AS indicator, * FROM mass UNION ALL SELECT 2, * FROM tmass) m
WHERE service IN (SELECT service FROM (SELECT service, count(*) AS k FROM xs WHERE w <= {v.TRAIN_US} GROUP BY service) WHERE k >= CASE m.indicator WHEN 1 THEN 78 ELSE 19 END)
  AND service <> 'signup'"""
)
def publish_ready_models(spark: E, d: str) -> DataFrame:
    """Both models of the services whose reference windows suffice; one service's generation changes while its models are built."""
    counts = v.xs(spark, d).where(F.col("w") <= v.TRAIN_US).groupBy("service").agg(F.count("*").alias("eligible"))
    counts = counts.withColumn("interval_s", F.lit(v.WINDOW // 1_000_000)).withColumn("generation", F.expr(GENERATION))
    ready = [model.ready_by_count(counts, 78), model.ready_by_day(counts)]
    now = counts.select("service", (F.col("generation") + (F.col("service") == "signup").cast("int")).alias("generation"))
    out = None
    for k, (mass, r) in enumerate(zip((v.published(spark, d), v.tod_mass(spark, d)), ready, strict=True), 1):
        part = model.publish(mass, r, now, v.MODEL).select(F.lit(k).alias("indicator"), "service", "x", r9("v").alias("v"), "n", "generation")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""SELECT service, indicator, CASE WHEN indicator = 1 AND eligible >= 1100 OR indicator = 2 AND least(eligible / needed, 1.0) >= 0.95 THEN 'ready' ELSE 'learning' END AS state,
  round(least(eligible / needed, 1.0), 9) AS coverage, round(least(eligible / needed, 1.0), 9) AS progress, CASE WHEN indicator = 1 THEN 1100 ELSE 5 END AS required, eligible, built_at
FROM (SELECT *, CASE WHEN indicator = 1 THEN 1100 ELSE 1200 END AS needed FROM ({ELIGIBLE})) e LEFT JOIN (SELECT o_orderpriority AS service, CAST(1 + o_custkey % 2 AS INTEGER) AS indicator, max(epoch_us(o_orderdate)) AS built_at
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) b USING (service, indicator)"""
)
def model_status(spark: E, d: str) -> DataFrame:
    """Status of both indicators' models: the first needs chunks by number, the second five days of windows (of six minutes here)."""
    counts = eligible_counts(spark, d)
    by_count = model.ready_by_count(counts.where("indicator = 1"), 1100).withColumn("required", F.lit(1100))
    by_day = model.ready_by_day(counts.where("indicator = 2").withColumn("interval_s", F.lit(360))).withColumn("required", F.lit(model.READY_DAYS_S // 86_400))
    ready = by_count.unionByName(by_day.select(*by_count.columns)).withColumn("coverage", r9("coverage"))
    o = v.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("service"), F.expr("1 + o_custkey % 2").cast("int").alias("indicator"), micros("o_orderdate").alias("us"))
    return model.status(ready, o, ["service", "indicator"])


# --- scoring -----------------------------------------------------------------------------------------------------


def scored(spark: E, d: str) -> DataFrame:
    """Samples of the scored windows with their level and reference probability f."""
    x, y, m = v.chunk_store(spark, d)
    rows = y.join(scoring.levels(x, m, v.MODEL).select("service", "w", "level"), v.KEY)
    return scoring.probabilities(rows, model.conditional_points(m, v.MODEL), v.MODEL)


@query("SELECT service, w, round(v, 9) AS v, round(f, 9) AS f FROM interp")
def linear_interpolation(spark: E, d: str) -> DataFrame:
    return scored(spark, d).select("service", "w", r9("v").alias("v"), r9("f").alias("f"))


@query("SELECT service, w, round(d, 9) AS d, round(z, 9) AS z, entries, n FROM kstat")
def ks_statistic(spark: E, d: str) -> DataFrame:
    return scoring.ks(scored(spark, d), v.KEY).select("service", "w", r9("d").alias("d"), r9("z").alias("z"), "entries", "n")


@query("SELECT service, w, round(p, 9) AS p FROM pvalue")
def kolmogorov_pvalue(spark: E, d: str) -> DataFrame:
    return scoring.ks(scored(spark, d), v.KEY).select("service", "w", r9(kolmogorov_p(F.col("z"))).alias("p"))


@query("SELECT service, w, p < 0.01 AS significant FROM pvalue")
def significance(spark: E, d: str) -> DataFrame:
    return scoring.ks(scored(spark, d), v.KEY).select("service", "w", significant(F.col("p")).alias("significant"))


def analysed(spark: E, d: str) -> DataFrame:
    return scoring.analyse(*v.chunk_store(spark, d), v.MODEL)


@query("SELECT service, w, x, level, pts AS points, round(d, 9) AS d, round(z, 9) AS z, round(p, 9) AS p, state FROM analysis")
def chunk_analysis(spark: E, d: str) -> DataFrame:
    """Every scored window with its verdict: the flagship query."""
    return analysed(spark, d).select("service", "w", "x", "level", "points", r9("d").alias("d"), r9("z").alias("z"), r9("p").alias("p"), "state")


@query("SELECT service, w, x, level, pts AS points, round(d, 9) AS d, round(z, 9) AS z, round(p, 9) AS p, state FROM tanalysis")
def time_of_day_analysis(spark: E, d: str) -> DataFrame:
    """Every scored window with the verdict of its hourly loads at that time of day."""
    return tod_analysed(spark, d).select("service", "w", "x", "level", "points", r9("d").alias("d"), r9("z").alias("z"), r9("p").alias("p"), "state")


def tod_analysed(spark: E, d: str) -> DataFrame:
    y = v.stored(v.tod_samples(spark, d, f"ts > {v.TRAIN_TS}"), "tod-chunks")
    return scoring.analyse(v.tod_chunks(y), y, v.tod_mass(spark, d), v.MODEL)


@query(
    """SELECT service, state, count(*) AS chunks FROM (
  SELECT service, CASE WHEN service = 'click' THEN 'baseline' WHEN service = 'view' AND w % 7 = 0 THEN 'failed' ELSE state END AS state FROM analysis) GROUP BY service, state"""
)
def verdict_state(spark: E, d: str) -> DataFrame:
    """Outcomes by service where one service has no model and some windows of another have no samples."""
    m = v.published(spark, d).where("service <> 'click'")
    y = v.score_samples(spark, d).where("not (service = 'view' and w % 7 = 0)")
    return scoring.analyse(v.score_chunks(spark, d), y, m, v.MODEL).groupBy("service", "state").agg(F.count("*").alias("chunks"))


ACTIVE = "SELECT service, max(generation) AS active FROM generations GROUP BY service"


def generation_rows(spark: E, d: str) -> DataFrame:
    return services.generations(v.revisions(spark, d), "service", ["at_s", "id"], ["priority"])


@query(f"SELECT id, service, generation FROM generations g JOIN ({ACTIVE}) a USING (service) WHERE generation = active")
def generation_guard(spark: E, d: str) -> DataFrame:
    rows = generation_rows(spark, d)
    active = rows.groupBy("service").agg(F.max("generation").alias("generation"))
    return upsert.generation_guard(rows.select("id", "service", "generation"), active, "service")


@query(
    f"""SELECT c.service, c.kind, c.generation, coalesce(s.state, 'pending') AS state FROM ({STANDING}) c LEFT JOIN (
  SELECT * FROM (SELECT w.service, w.kind, w.state, row_number() OVER (PARTITION BY w.service, w.kind ORDER BY w.analysed_at DESC, w.id DESC) AS k
    FROM (SELECT service, kind, id % 2 AS generation, collected_at + 1 AS analysed_at, id, CASE WHEN id % 5 = 0 THEN 'bad' ELSE 'good' END AS state FROM ({WRITES})) w
    JOIN ({STANDING}) g ON g.service = w.service AND g.kind = w.kind AND g.generation = w.generation) WHERE k = 1) s ON s.service = c.service AND s.kind = c.kind"""
)
def verdict_upsert(spark: E, d: str) -> DataFrame:
    writes = chunk_writes(spark, d)
    verdicts = writes.select(*WRITE_KEY, F.expr("id % 2").alias("generation"), (F.col("collected_at") + 1).alias("analysed_at"), "id", F.when(F.col("id") % 5 == 0, "bad").otherwise("good").alias("state"))
    return upsert.verdict_upsert(verdicts, upsert.chunk_upsert(writes, WRITE_KEY), WRITE_KEY)


@query(
    """SELECT o.event_id AS chunk, o.service, o.w, a.state, o.us = max(o.us) OVER (PARTITION BY o.service, o.w) AS "primary"
FROM win o JOIN analysis a USING (service, w)"""
)
def verdict_fanout(spark: E, d: str) -> DataFrame:
    results = analysed(spark, d).select("service", "w", "state")
    out = upsert.fan_out(results, v.win(spark, d).select("service", "w", "us", F.col("event_id").alias("chunk")), v.KEY)
    return out.select("chunk", "service", "w", "state", "primary")


@query("SELECT id, service, indicator, state FROM verdicts WHERE NOT historical")
def live_outcomes(spark: E, d: str) -> DataFrame:
    return v.verdicts(spark, d).where(~F.col("historical")).select("id", "service", "indicator", "state")


@query(
    """SELECT service, w, round(max(greatest(abs(f - (cum - 1) / n), abs(cum / n - f))), 9) AS d FROM (
  SELECT service, w, f, cum, n FROM (SELECT service, w, f, sum(c) OVER (PARTITION BY service, w ORDER BY f) AS cum, sum(c) OVER (PARTITION BY service, w) AS n
    FROM (SELECT service, w, f, sum(c) AS c FROM interp GROUP BY service, w, f))) GROUP BY service, w"""
)
def pit_uniform_ks(spark: E, d: str) -> DataFrame:
    """Probability transforms of a window's values tested against the uniform distribution."""
    pits = scored(spark, d).groupBy("service", "w", F.col("f").alias("v")).agg(F.sum("c").alias("c")).withColumn("f", F.col("v"))
    return scoring.ks(pits, v.KEY).select("service", "w", r9("d").alias("d"))

