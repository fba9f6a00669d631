"""The engine's inputs as views over the given tables, in Spark and (for VIEWS) in SQL.

Services are event types, a window is six hours, the load of a window is its
number of events and the response is the events' value. Windows that end up
to 2024-01-21 are the reference; later ones are scored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condist.functions.shared import stored
from condist.functions.times import DAY, HOUR, micros
from condist.operators import model, samples, windows
from condist.plans.registry import VIEWS

WINDOW = 6 * HOUR
TRAIN_US = 1_705_795_200_000_000
#: Clock of jobs that need one: 2024-01-31 00:00 UTC.
NOW_US = 1_706_659_200_000_000
#: End of the order dates' range, for jobs over orders.
KEY = ["service", "w"]
MODEL = ["service"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def obs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("service"), "user_id", "ts", "value")
    return e.withColumn("us", micros("ts"))


VIEWS["obs"] = "SELECT event_id, event_type AS service, user_id, ts, value, epoch_us(ts) AS us FROM events"


def win(spark: SparkSession, d: str, interval: int = WINDOW) -> DataFrame:
    return windows.assign(obs(spark, d), interval)


VIEWS["win"] = f"SELECT *, ((us + {WINDOW} - 1) // {WINDOW}) * {WINDOW} AS w FROM obs"


TRAIN_TS = "timestamp_ntz'2024-01-21 00:00:00'"


def ys(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Response samples in long form: service, w, v, c. ``where`` is on the observations, so that it reaches the scan."""
    return samples.count_samples(win(spark, d).where(where), KEY)


VIEWS["ys"] = "SELECT service, w, value AS v, count(*) AS c FROM win GROUP BY service, w, value"


def xs(spark: SparkSession, d: str) -> DataFrame:
    """The load of each window: service, w, x."""
    return win(spark, d).groupBy(*KEY).agg(F.count("*").cast("double").alias("x"))


VIEWS["xs"] = "SELECT service, w, CAST(count(*) AS DOUBLE) AS x FROM win GROUP BY service, w"


def mass(spark: SparkSession, d: str) -> DataFrame:
    """Joint mass of the reference windows.

    A window has one load, the number of its events, so the mass needs no join
    of loads with responses: the load is a sum over the window's samples. The
    events are dealt by window once, for counting and for that sum.
    """
    return pairs(loaded(win(spark, d).where(f"ts <= {TRAIN_TS}"))).groupBy(*MODEL, "x", "v").agg(F.sum("n").alias("n"))


def loaded(rows: DataFrame) -> DataFrame:
    """Samples of windows with the window's load x, dealt by window once."""
    load = F.sum("c").over(Window.partitionBy(*KEY)).cast("double")
    return samples.count_samples(rows.select(*KEY, "value").repartition(*KEY), KEY).withColumn("x", load)


def pairs(chunks: DataFrame) -> DataFrame:
    """The (x, v) pairs of each chunk with their mass n, not yet added up."""
    return chunks.select(*MODEL, "x", "v", F.col("c").alias("n"))


def published(spark: SparkSession, d: str) -> DataFrame:
    """The joint mass as a published model: near values brought together, built once, read by level lookup, point counts and interpolation."""
    return coalesced(loaded(win(spark, d).where(f"ts <= {TRAIN_TS}")))


def coalesced(chunks: DataFrame) -> DataFrame:
    return model.coalesce_near(pairs(chunks), MODEL, by=("x",))


def tod_samples(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Load samples of the windows: the events of each hour with any, as service, w, v, c."""
    hours = win(spark, d).where(where).groupBy(*KEY, F.expr(f"(us + {HOUR} - 1) div {HOUR}").alias("h")).agg(F.count("*").cast("double").alias("value"))
    return samples.count_samples(hours, KEY)


def tod_chunks(rows: DataFrame) -> DataFrame:
    """Time-of-day chunks of load samples: x is the UTC second of the day at the window's end."""
    return rows.select(*KEY).distinct().withColumn("x", samples.time_of_day("w").cast("double"))


def tod_mass(spark: SparkSession, d: str) -> DataFrame:
    y = stored(tod_samples(spark, d, f"ts <= {TRAIN_TS}"), "tod-chunks")
    mass = model.joint_mass(tod_chunks(y).withColumn("cx", F.lit(1).cast("long")), y, KEY, MODEL)
    return model.coalesce_near(mass, MODEL, by=("x",))


VIEWS["mass"] = f"SELECT service, x, v, CAST(sum(c) AS BIGINT) AS n FROM xs JOIN ys USING (service, w) WHERE w <= {TRAIN_US} GROUP BY service, x, v"
VIEWS["points"] = "SELECT service, x, v, sum(n) OVER (PARTITION BY service, x ORDER BY v) / sum(n) OVER (PARTITION BY service, x) AS p FROM mass"
VIEWS["score_x"] = f"""
SELECT s.service, s.w, s.x, coalesce(l.x, (SELECT min(m.x) FROM mass m WHERE m.service = s.service)) AS level
FROM (SELECT * FROM xs WHERE w > {TRAIN_US}) s
ASOF LEFT JOIN (SELECT DISTINCT service, x FROM mass) l ON s.service = l.service AND s.x >= l.x"""
VIEWS["probes"] = "SELECT y.service, y.w, y.v, y.c, s.level FROM ys y JOIN score_x s USING (service, w)"
VIEWS["interp"] = """
SELECT p.service, p.w, p.level, p.v, p.c,
  CASE WHEN lo.v IS NULL THEN CASE WHEN hi.v = p.v THEN hi.p ELSE 0 END
       WHEN hi.v IS NULL THEN 1
       ELSE lo.p + (p.v - lo.v) * (hi.p - lo.p) / (hi.v - lo.v) END AS f
FROM probes p
ASOF LEFT JOIN points lo ON p.service = lo.service AND p.level = lo.x AND p.v > lo.v
ASOF LEFT JOIN points hi ON p.service = hi.service AND p.level = hi.x AND p.v <= hi.v"""
VIEWS["kstat"] = """
SELECT service, w, max(greatest(abs(f - (cum - 1) / n), abs(cum / n - f))) AS d, count(*) AS entries, CAST(max(n) AS BIGINT) AS n,
  max(greatest(abs(f - (cum - 1) / n), abs(cum / n - f))) * sqrt(count(*)) AS z
FROM (SELECT *, sum(c) OVER (PARTITION BY service, w ORDER BY v) AS cum, sum(c) OVER (PARTITION BY service, w) AS n FROM interp)
GROUP BY service, w"""
# fixed values: limits and constants of the Kolmogorov series, as in functions/stats.py
VIEWS["pvalue"] = """
SELECT *, CASE WHEN z < 0.2 THEN 1.0
  WHEN z < 0.755 THEN 1 - 2.50662827 * (exp(-1.2337005501361697 / (z*z)) + exp(9 * -1.2337005501361697 / (z*z)) + exp(25 * -1.2337005501361697 / (z*z))) / z
  WHEN z < 6.8116 THEN 2 * (exp(-2*z*z)
    - CASE WHEN greatest(round_even(3/z, 0), 1) >= 2 THEN exp(-8*z*z) ELSE 0 END
    + CASE WHEN greatest(round_even(3/z, 0), 1) >= 3 THEN exp(-18*z*z) ELSE 0 END
    - CASE WHEN greatest(round_even(3/z, 0), 1) >= 4 THEN exp(-32*z*z) ELSE 0 END)
  ELSE 0.0 END AS p
FROM kstat"""
VIEWS["analysis"] = """
SELECT s.service, s.w, s.x, s.level, k.pts, t.d, t.z, t.p,
  CASE WHEN k.pts IS NULL THEN 'baseline' WHEN k.pts < 2 OR t.p IS NULL THEN 'failed' WHEN t.p < 0.01 THEN 'bad' ELSE 'good' END AS state
FROM score_x s
LEFT JOIN (SELECT service, x AS level, count(*) AS pts FROM points GROUP BY service, x) k ON k.service = s.service AND k.level = s.level
LEFT JOIN pvalue t ON t.service = s.service AND t.w = s.w AND k.pts >= 2"""


# the same for time of day (indicator 2): x is the second of the day, samples are the events of the window's hours
VIEWS["tys"] = f"""
SELECT service, w, v, count(*) AS c FROM (SELECT service, w, (us + {HOUR} - 1) // {HOUR} AS h, CAST(count(*) AS DOUBLE) AS v FROM win GROUP BY ALL) GROUP BY service, w, v"""
VIEWS["txs"] = "SELECT DISTINCT service, w, CAST((w // 1000000) % 86400 AS DOUBLE) AS x FROM tys"
TIME_OF_DAY = {"ys": "tys", "xs": "txs"} | {name: f"t{name}" for name in ("mass", "points", "score_x", "probes", "interp", "kstat", "pvalue", "analysis")}
for _name in ("mass", "points", "score_x", "probes", "interp", "kstat", "pvalue", "analysis"):
    VIEWS[TIME_OF_DAY[_name]] = re.sub(r"\w+", lambda m: TIME_OF_DAY.get(m[0], m[0]), VIEWS[_name])


def score_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The scored windows with their load, from their samples."""
    return score_samples(spark, d).groupBy(*KEY).agg(F.sum("c").cast("double").alias("x"))


def chunk_store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scored windows (service, w, x), their samples and the published mass, from one chunk table that one pass over the events stores."""
    kept = stored(loaded(win(spark, d)).withColumn("reference", F.col("w") <= TRAIN_US), "chunks", by=["reference"])
    y = kept.where("not reference").select(*KEY, "v", "c")
    return y.groupBy(*KEY).agg(F.sum("c").cast("double").alias("x")), y, coalesced(kept.where("reference"))


def score_samples(spark: SparkSession, d: str) -> DataFrame:
    return ys(spark, d, f"ts > {TRAIN_TS}")


# --- verdicts: orders as analysed chunks -------------------------------------------------------------------------

HASH = "(7 * o_orderkey) % 11"


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """service, indicator, us, id, state, historical, review_override."""
    o = table(spark, d, "orders")
    state = F.expr(f"case when {HASH} <= 3 then 'bad' when {HASH} = 4 then 'failed' when {HASH} = 5 then 'baseline' else 'good' end")
    return o.select(
        F.col("o_orderpriority").alias("service"),
        F.expr("1 + o_custkey % 2").cast("int").alias("indicator"),
        micros("o_orderdate").alias("us"),
        F.col("o_orderkey").alias("id"),
        state.alias("state"),
        F.expr("o_orderkey % 5 = 0").alias("historical"),
        F.when((state == "bad") & F.expr("o_orderkey % 3 = 0"), True).alias("review_override"),
        F.expr("1 + (o_orderkey div 8) % 2").alias("generation"),
    )


def monitored(spark: SparkSession, d: str) -> DataFrame:
    """The services of the verdicts with their active generation."""
    names = table(spark, d, "orders").select(F.col("o_orderpriority").alias("service")).distinct()
    return names.withColumn("generation", F.when(F.col("service") < "3", 1).otherwise(2).cast("long"))


VIEWS["verdicts"] = f"""
SELECT o_orderpriority AS service, CAST(1 + o_custkey % 2 AS INTEGER) AS indicator, epoch_us(o_orderdate) AS us, o_orderkey AS id,
  CASE WHEN {HASH} <= 3 THEN 'bad' WHEN {HASH} = 4 THEN 'failed' WHEN {HASH} = 5 THEN 'baseline' ELSE 'good' END AS state,
  o_orderkey % 5 = 0 AS historical,
  CASE WHEN {HASH} <= 3 AND o_orderkey % 3 = 0 THEN true END AS review_override, 1 + (o_orderkey // 8) % 2 AS generation
FROM orders"""
VIEWS["eligible"] = "SELECT * FROM verdicts WHERE state IN ('baseline', 'good') OR (state = 'bad' AND coalesce(review_override, false))"


# --- attempts: events of a user as collection attempts -----------------------------------------------------------


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """service (user_id), us, id, failed, w (its hour)."""
    e = windows.assign(obs(spark, d), HOUR)
    return e.select(F.col("user_id").alias("service"), "us", F.col("event_id").alias("id"), (F.col("service") == "error").alias("failed"), "w", F.col("service").alias("kind"))


VIEWS["attempts"] = f"""
SELECT user_id AS service, epoch_us(ts) AS us, event_id AS id, event_type = 'error' AS failed,
  ((epoch_us(ts) + {HOUR} - 1) // {HOUR}) * {HOUR} AS w, event_type AS kind FROM events"""


def backlog(spark: SparkSession, d: str) -> DataFrame:
    """Failed windows: service, w, first_us, attempts, last_us, expires_us."""
    f = attempts(spark, d).where("failed").groupBy("service", "w")
    return f.agg(F.min("us").alias("first_us"), F.count("*").alias("attempts"), F.max("us").alias("last_us")).withColumn("expires_us", F.col("first_us") + DAY)


VIEWS["backlog"] = f"""
SELECT service, w, min(us) AS first_us, count(*) AS attempts, max(us) AS last_us, min(us) + {DAY} AS expires_us
FROM attempts WHERE failed GROUP BY service, w"""


# --- versions: orders as model publications ----------------------------------------------------------------------


def publications(spark: SparkSession, d: str) -> DataFrame:
    """service, indicator, interval_end (us), id, body, bytes, checksum (wrong for every fourth)."""
    o = table(spark, d, "orders")
    body = F.concat(F.lit("model-"), F.col("o_orderkey").cast("string")).cast("binary")
    return o.select(
        F.col("o_orderpriority").alias("service"),
        F.col("o_orderstatus").alias("indicator"),
        micros("o_orderdate").alias("interval_end"),
        F.col("o_orderkey").alias("id"),
        F.when(F.expr("o_orderkey % 7 = 0"), F.lit(b"")).otherwise(body).alias("body"),
        F.length(body).cast("long").alias("bytes"),
        F.sha2(F.when(F.expr("o_orderkey % 4 = 0"), F.lit(b"broken")).otherwise(body), 256).alias("checksum"),
    )


VIEWS["publications"] = """
SELECT o_orderpriority AS service, o_orderstatus AS indicator, epoch_us(o_orderdate) AS interval_end, o_orderkey AS id,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'model-' || o_orderkey END AS body, CAST(length('model-' || o_orderkey) AS BIGINT) AS bytes,
  CASE WHEN o_orderkey % 4 = 0 THEN sha256('broken') ELSE sha256('model-' || o_orderkey) END AS checksum
FROM orders"""
VIEWS["versions"] = """
SELECT *, row_number() OVER (PARTITION BY service, indicator ORDER BY interval_end) AS version
FROM (SELECT *, row_number() OVER (PARTITION BY service, indicator, interval_end ORDER BY id) AS k FROM publications WHERE body <> '') WHERE k = 1"""
VIEWS["kept"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service, indicator ORDER BY version DESC) AS r FROM versions) WHERE r <= 5"


# --- revisions: orders of a customer as configuration changes ----------------------------------------------------


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """service (custkey), at_s, id, priority, status, interval_s."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("service"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("at_s"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.expr("60 * (1 + o_orderkey % 4)").cast("long").alias("interval_s"),
    )


VIEWS["revisions"] = """
SELECT o_custkey AS service, epoch_us(o_orderdate) // 1000000 AS at_s, o_orderkey AS id, o_orderpriority AS priority, o_orderstatus AS status,
  CAST(60 * (1 + o_orderkey % 4) AS BIGINT) AS interval_s FROM orders"""
VIEWS["generations"] = """
SELECT *, CAST(1 + sum(CASE WHEN before IS NOT NULL AND before <> priority THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY at_s, id) AS BIGINT) AS generation
FROM (SELECT *, lag(priority) OVER (PARTITION BY service ORDER BY at_s, id) AS before FROM revisions)"""


# --- deliveries: line items as notification rows -----------------------------------------------------------------


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """alert, id, operation, state, attempts, severity, us (of the next attempt)."""
    i = table(spark, d, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("alert"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.when(F.col("l_returnflag") == "R", "resolved").otherwise("firing").alias("operation"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "pending").when(F.col("l_returnflag") == "A", "missed").otherwise("delivered").alias("state"),
        F.col("l_linenumber").cast("long").alias("attempts"),
        F.when(F.col("l_quantity") > 25, "critical").otherwise("warning").alias("severity"),
        micros("l_shipdate").alias("us"),
        F.expr("1000 * l_partkey + l_suppkey").alias("part"),
    )


VIEWS["deliveries"] = """
SELECT l_orderkey AS alert, CAST(l_linenumber AS INTEGER) AS line, CASE WHEN l_returnflag = 'R' THEN 'resolved' ELSE 'firing' END AS operation,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'pending' WHEN l_returnflag = 'A' THEN 'missed' ELSE 'delivered' END AS state,
  CAST(l_linenumber AS BIGINT) AS attempts, CASE WHEN l_quantity > 25 THEN 'critical' ELSE 'warning' END AS severity,
  epoch_us(l_shipdate) AS us, 1000 * l_partkey + l_suppkey AS part
FROM lineitem"""
