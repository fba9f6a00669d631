"""Queries of models in versions, fed by their own verdicts: both indicators, a publication every six days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.functions.shared import shared_folder, stored
from condist.functions.times import DAY, HOUR
from condist.operators import model, versions
from condist.plans import views as v
from condist.plans.registry import query

E = SparkSession
START = 1_704_067_200_000_000
ENDS = [START + k * 6 * DAY for k in range(1, 6)]
#: The configuration of one service changes in the middle of a window, between two publications.
CHANGED, CHANGE = "signup", START + 14 * DAY + 3 * HOUR
REQUIRED = 10
r9 = lambda c: F.round(c, 9)


def tables(spark: E, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chunks, samples, services and reviews. Of bad chunks every third is accepted after two days, and every sixth taken back after seven."""
    # in order of time, so that a step reads its own stretch only
    loads, hours = stored(v.ys(spark, d).sortWithinPartitions("w"), "samples"), stored(v.tod_samples(spark, d), "tod-samples")
    x1 = loads.groupBy(*v.KEY).agg(F.sum("c").cast("double").alias("x"))
    samples = loads.withColumn("indicator", F.lit(1)).unionByName(hours.withColumn("indicator", F.lit(2)))
    chunks = x1.withColumn("indicator", F.lit(1)).unionByName(v.tod_chunks(hours).withColumn("indicator", F.lit(2)))
    collected = F.when((F.col("service") == CHANGED) & (F.col("w") - v.WINDOW >= CHANGE), 2).otherwise(1).cast("long")
    chunks = stored(chunks.withColumn("generation", collected), "chunks")
    names = chunks.select("service").distinct()
    first = names.select("service", F.lit(1).cast("long").alias("generation"), F.lit(0).cast("long").alias("since_us"))
    second = names.where(F.col("service") == CHANGED).select("service", F.lit(2).cast("long").alias("generation"), F.lit(CHANGE).alias("since_us"))
    number = F.expr(f"w div {v.WINDOW}")
    taken = chunks.where(number % 3 == 0).select(*versions.CHUNK, (F.col("w") + 2 * DAY).alias("us"), F.lit(True).alias("accept"))
    back = chunks.where(number % 6 == 0).select(*versions.CHUNK, (F.col("w") + 7 * DAY).alias("us"), F.lit(False).alias("accept"))
    return chunks, samples, stored(first.unionByName(second), "services"), stored(taken.unionByName(back), "reviews")


def ready(counts: DataFrame) -> DataFrame:
    """Ten chunks for load, and 95 percent of five days' windows for time of day."""
    both = [
        model.ready_by_count(counts.where("indicator = 1"), REQUIRED),
        model.ready_by_day(counts.where("indicator = 2").withColumn("interval_s", F.lit(v.WINDOW // 1_000_000))),
    ]
    return reduce(DataFrame.unionByName, [b.select(*counts.columns, "ready") for b in both])


def learned(spark: E, d: str) -> str:
    """The folder of all steps."""
    root = shared_folder(spark, "versions")
    versions.learn(spark, root, START, ENDS, *tables(spark, d), ready)
    return root


def _steps_sql() -> dict[str, str]:
    """The same by building each version anew from all eligible chunks."""
    number = f"w // {v.WINDOW}"
    out = {
        "vs": "SELECT 1 AS indicator, service, w, v, c FROM ys UNION ALL SELECT 2, service, w, v, c FROM tys",
        "vc": f"""SELECT *, CASE WHEN service = '{CHANGED}' AND w - {v.WINDOW} >= {CHANGE} THEN 2 ELSE 1 END AS generation
FROM (SELECT 1 AS indicator, service, w, x FROM xs UNION ALL SELECT 2, service, w, x FROM txs)""",
        "vr": f"""SELECT indicator, service, w, w + {2 * DAY} AS us, true AS accept FROM vc WHERE ({number}) % 3 = 0
UNION ALL SELECT indicator, service, w, w + {7 * DAY}, false FROM vc WHERE ({number}) % 6 = 0""",
        "model0": "SELECT indicator, service, generation, 0 AS version, x, CAST(0 AS DOUBLE) AS v, 0 AS n FROM vc WHERE false",
        "man0": "SELECT indicator, service, generation, 0 AS version, 0 AS interval_end, 0 AS eligible FROM vc WHERE false",
    }
    key, on = "indicator, service, generation", lambda a, b: f"{a}.indicator = {b}.indicator AND {a}.service = {b}.service AND {a}.generation = {b}.generation"
    for k, end in enumerate(ENDS, 1):
        start = ENDS[k - 2] if k > 1 else START
        m = f"model{k - 1}"
        out |= {
            f"q{k}": f"SELECT * FROM vc WHERE w > {start} AND w <= {end} AND generation = CASE WHEN service = '{CHANGED}' AND w >= {CHANGE} THEN 2 ELSE 1 END",
            f"pt{k}": f"SELECT {key}, x, v, sum(n) OVER (PARTITION BY {key}, x ORDER BY v) / sum(n) OVER (PARTITION BY {key}, x) AS p FROM {m}",
            f"lv{k}": f"SELECT {key}, x, count(*) AS pts FROM pt{k} GROUP BY ALL",
            f"sx{k}": f"""SELECT q.*, coalesce(l.x, f.x) AS level, coalesce(l.pts, f.pts) AS pts FROM q{k} q
ASOF LEFT JOIN lv{k} l ON {on('q', 'l')} AND q.x >= l.x
LEFT JOIN (SELECT {key}, min(x) AS x, arg_min(pts, x) AS pts FROM lv{k} GROUP BY {key}) f ON {on('q', 'f')}""",
            f"in{k}": f"""SELECT p.indicator, p.service, p.generation, p.w, p.v, p.c,
  CASE WHEN lo.v IS NULL THEN CASE WHEN hi.v = p.v THEN hi.p ELSE 0 END WHEN hi.v IS NULL THEN 1 ELSE lo.p + (p.v - lo.v) * (hi.p - lo.p) / (hi.v - lo.v) END AS f
FROM (SELECT s.*, q.generation, q.level FROM vs s JOIN sx{k} q USING (indicator, service, w) WHERE q.pts >= 2) p
ASOF LEFT JOIN pt{k} lo ON {on('p', 'lo')} AND p.level = lo.x AND p.v > lo.v
ASOF LEFT JOIN pt{k} hi ON {on('p', 'hi')} AND p.level = hi.x AND p.v <= hi.v""",
            f"ks{k}": f"""SELECT {key}, w, d, d * sqrt(entries) AS z FROM (SELECT {key}, w, max(greatest(abs(f - (cum - 1) / n), abs(cum / n - f))) AS d, count(*) AS entries
  FROM (SELECT *, sum(c) OVER (PARTITION BY {key}, w ORDER BY v) AS cum, sum(c) OVER (PARTITION BY {key}, w) AS n FROM in{k}) GROUP BY {key}, w)""",
            f"vd{k}": f"""SELECT q.indicator, q.service, q.generation, q.w, q.x, q.level, q.pts, t.p, (SELECT max(version) FROM {m} g WHERE {on('g', 'q')}) AS version,
  CASE WHEN q.pts IS NULL THEN 'baseline' WHEN q.pts < 2 OR t.p IS NULL THEN 'failed' WHEN t.p < 0.01 THEN 'bad' ELSE 'good' END AS state
FROM sx{k} q LEFT JOIN ({v.VIEWS['pvalue'].replace('kstat', f'ks{k}')}) t ON {on('t', 'q')} AND t.w = q.w""",
            f"al{k}": (f"SELECT * FROM al{k - 1} UNION ALL " if k > 1 else "") + f"SELECT * FROM vd{k}",
            f"el{k}": f"""SELECT a.* FROM al{k} a LEFT JOIN (SELECT indicator, service, w, arg_max(accept, us) AS accept FROM vr WHERE us <= {end} GROUP BY ALL) r USING (indicator, service, w)
WHERE (a.state IN ('baseline', 'good') OR (a.state = 'bad' AND coalesce(r.accept, false))) AND a.generation = CASE WHEN a.service = '{CHANGED}' AND {end} >= {CHANGE} THEN 2 ELSE 1 END""",
            f"new{k}": f"""SELECT {key}, {end} AS interval_end, eligible, 1 + coalesce((SELECT max(version) FROM man{k - 1} g WHERE {on('g', 'e')}), 0) AS version
FROM (SELECT {key}, count(*) AS eligible FROM el{k} GROUP BY ALL) e WHERE CASE indicator WHEN 1 THEN eligible >= {REQUIRED} ELSE least(eligible / 20, 1.0) >= 0.95 END""",
            f"man{k}": f"SELECT {key}, version, interval_end, eligible FROM man{k - 1} UNION ALL SELECT {key}, version, interval_end, eligible FROM new{k}",
            f"model{k}": f"""SELECT e.indicator, e.service, e.generation, any_value(n.version) AS version, e.x, s.v, CAST(sum(s.c) AS BIGINT) AS n
FROM el{k} e JOIN new{k} n ON {on('e', 'n')} JOIN vs s ON s.indicator = e.indicator AND s.service = e.service AND s.w = e.w GROUP BY e.indicator, e.service, e.generation, e.x, s.v
UNION ALL SELECT m.* FROM {m} m WHERE NOT EXISTS (SELECT 1 FROM new{k} n WHERE {on('m', 'n')})""",
        }
    return out


def _sql(body: str) -> str:
    steps = _steps_sql()
    inner = ",\n".join(f"{name} AS MATERIALIZED (\n{text}\n)" for name, text in steps.items())
    return f"SELECT * FROM (WITH {inner}\n{body})"


LAST = len(ENDS)


@query(_sql(f"SELECT service, CAST(indicator AS INTEGER) AS indicator, w, CAST(generation AS BIGINT) AS generation, CAST(version AS BIGINT) AS version, level, pts AS points, round(p, 9) AS p, state FROM al{LAST}"))
def versioned_verdicts(spark: E, d: str) -> DataFrame:
    """Every chunk's verdict by the version that was in force for it."""
    found = versions.read(spark, learned(spark, d), "verdicts", versions.VERDICTS, range(1, LAST + 1))
    return found.select("service", "indicator", "w", "generation", "version", "level", "points", r9("p").alias("p"), "state")


BROKEN = "service = 'click' AND interval_end = " + str(ENDS[-1])
PAIRS = " UNION ALL ".join(f"SELECT indicator, service, generation, version, count(*) AS pairs FROM model{k} WHERE version IN (SELECT version FROM new{k} n WHERE n.indicator = model{k}.indicator AND n.service = model{k}.service AND n.generation = model{k}.generation) GROUP BY ALL" for k in range(1, LAST + 1))


@query(
    _sql(
        f"""SELECT service, CAST(indicator AS INTEGER) AS indicator, CAST(generation AS BIGINT) AS generation, CAST(version AS BIGINT) AS version, CAST(interval_end AS BIGINT) AS interval_end, eligible, pairs, kept,
  coalesce(NOT broken AND version = max(CASE WHEN NOT broken THEN version END) OVER (PARTITION BY indicator, service, generation), false) AS current FROM (
  SELECT *, row_number() OVER (PARTITION BY indicator, service, generation ORDER BY version DESC) <= 5 AS kept, {BROKEN} AS broken
  FROM man{LAST} JOIN ({PAIRS}) USING (indicator, service, generation, version))"""
    )
)
def version_manifest(spark: E, d: str) -> DataFrame:
    """All publications: which are kept, and which is the newest one whose body has its checksum (the last one of a service has not)."""
    root = learned(spark, d)
    manifest = versions.read(spark, root, "manifest", versions.MANIFEST, range(1, LAST + 1))
    manifest = manifest.withColumn("checksum", F.when(F.expr(BROKEN), "broken").otherwise(F.col("checksum")))
    newest = versions.in_force(versions.intact(spark, root, manifest)).select(*versions.MODEL, F.col("version").alias("_current"))
    last = manifest.groupBy(*versions.MODEL).agg(F.max("version").alias("_last"))
    rows = manifest.join(newest, versions.MODEL, "left").join(last, versions.MODEL)
    return rows.select(*versions.MODEL, "version", "interval_end", "eligible", "pairs", (F.col("version") > F.col("_last") - 5).alias("kept"), F.coalesce(F.col("version") == F.col("_current"), F.lit(False)).alias("current"))
