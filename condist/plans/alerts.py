"""Queries of alerts, evidence and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.functions.shared import stored
from condist.functions.times import DAY, micros
from condist.operators import alerts as a
from condist.operators import evidence as ev
from condist.operators import model, notify, samples, windows
from condist.plans import core
from condist.plans import views as v
from condist.plans.registry import VIEWS, query

E = SparkSession
SI = ["service", "indicator"]
#: Clock of the jobs over orders: 2000-01-01.
NOW = 946_684_800_000_000
r9 = lambda c: F.round(c, 9)


def events_of(df: DataFrame, occurs, ends, reason) -> DataFrame:
    return df.withColumn("occurs", occurs).withColumn("ends", ends).withColumn("reason", F.when(F.col("ends"), reason))


def live(spark: E, d: str) -> DataFrame:
    return v.verdicts(spark, d).where(~F.col("historical"))


def anomaly_events(spark: E, d: str) -> DataFrame:
    s = F.col("state")
    return events_of(live(spark, d), s == "bad", s == "good", F.lit("good_chunk"))


def conditions_sql(rows: str, keys: str) -> str:
    """SQL of alerts from rows with us, id, occurs, ends, reason."""
    at = "(us // 1000000) * 10000000 + id"
    return f"""
SELECT *, CASE WHEN resolved_us IS NULL THEN 'firing' ELSE 'resolved' END AS status, CASE WHEN occurrences >= 3 THEN 'critical' ELSE 'warning' END AS severity
FROM (SELECT {keys}, island, arg_min(id, {at}) FILTER (occurs) AS alert, min(us) FILTER (occurs) AS started_us, max(us) FILTER (occurs) AS last_us,
    count(*) FILTER (occurs) AS occurrences, max(us) FILTER (ends) AS resolved_us, max(reason) FILTER (ends) AS reason
  FROM (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM ({rows}))
  GROUP BY {keys}, island)
WHERE occurrences > 0"""


ALERT_COLUMNS = ["alert", "started_us", "last_us", "occurrences", "severity", "status", "resolved_us"]
ALERT_SQL = ", ".join(ALERT_COLUMNS)
ANOMALY = "SELECT *, state = 'bad' AS occurs, state = 'good' AS ends, 'good_chunk' AS reason FROM verdicts WHERE NOT historical"
VIEWS["anomalies"] = conditions_sql(ANOMALY, "service, indicator")
VIEWS["hits"] = f"""
SELECT *, row_number() OVER (PARTITION BY service, indicator, island ORDER BY us, id) AS n, first_value(id) OVER (PARTITION BY service, indicator, island ORDER BY us, id) AS alert
FROM (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY service, indicator ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM ({ANOMALY}))
WHERE occurs"""


@query(f"SELECT service, indicator, {ALERT_SQL} FROM anomalies")
def anomaly_alerts(spark: E, d: str) -> DataFrame:
    return a.conditions(anomaly_events(spark, d), SI).select(*SI, *ALERT_COLUMNS)


@query("SELECT severity, count(*) AS alerts, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM anomalies GROUP BY severity")
def alert_severity(spark: E, d: str) -> DataFrame:
    out = a.conditions(anomaly_events(spark, d), SI)
    return out.groupBy("severity").agg(F.count("*").alias("alerts"), F.sum("occurrences").alias("occurrences"))


@query(
    """SELECT 'chunk:' || service || ':' || indicator || ':' || us AS key, min(id) AS id,
  '{"historical":"false","indicator":"' || indicator || '","threshold":"0.01"}' AS evidence
FROM verdicts WHERE NOT historical AND state = 'bad' GROUP BY service, indicator, us"""
)
def anomaly_occurrences(spark: E, d: str) -> DataFrame:
    rows = a.unique_occurrences(live(spark, d).where("state = 'bad'"), ["service", "indicator", "us"])
    data = {"historical": F.col("historical").cast("string"), "indicator": F.col("indicator").cast("string"), "threshold": F.lit("0.01")}
    return rows.select("key", "id", F.to_json(F.struct(*[c.alias(k) for k, c in data.items()])).alias("evidence"))


LIFE = """
SELECT service, indicator, alert, us, CASE WHEN n = 1 THEN 'opened' ELSE 'occurrence_added' END AS event FROM hits
UNION ALL SELECT service, indicator, alert, us, 'escalated' FROM hits WHERE n = 3
UNION ALL SELECT service, indicator, alert, resolved_us, 'resolved' FROM anomalies WHERE status = 'resolved'"""


@query(LIFE)
def lifecycle_events(spark: E, d: str) -> DataFrame:
    return a.lifecycle(anomaly_events(spark, d), SI)


ATTEMPTS = "SELECT *, failed AS occurs, NOT failed AS ends, 'collection_recovered' AS reason FROM attempts"


@query(f"SELECT service, {ALERT_SQL} FROM ({conditions_sql(ATTEMPTS, 'service')})")
def collection_alerts(spark: E, d: str) -> DataFrame:
    failed = F.col("failed")
    events = events_of(v.attempts(spark, d), failed, ~failed, F.lit("collection_recovered"))
    return a.conditions(events, ["service"]).select("service", *ALERT_COLUMNS)


MONITOR = "SELECT *, 'anomaly_analysis' AS operation, state = 'failed' AS occurs, state IN ('good', 'bad') AS ends, 'analysis_recovered' AS reason FROM verdicts WHERE NOT historical"


def monitoring_events(spark: E, d: str) -> DataFrame:
    rows = live(spark, d).withColumn("operation", F.lit("anomaly_analysis"))
    return events_of(rows, F.col("state") == "failed", F.col("state").isin("good", "bad"), F.lit("analysis_recovered"))


VIEWS["monitor_hits"] = f"""
SELECT *, row_number() OVER (PARTITION BY service, operation, island ORDER BY us, id) AS n, first_value(id) OVER (PARTITION BY service, operation, island ORDER BY us, id) AS alert
  FROM (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY service, operation ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM ({MONITOR})) WHERE occurs"""


@query(
    f"""SELECT service, operation, alert, us, 'occurrence_added' AS event FROM monitor_hits
UNION ALL SELECT service, operation, alert, us, 'severity_changed' FROM monitor_hits WHERE n = 3
UNION ALL SELECT service, operation, alert, resolved_us, 'resolved' FROM ({conditions_sql(MONITOR, 'service, operation')}) WHERE status = 'resolved'"""
)
def monitoring_alerts(spark: E, d: str) -> DataFrame:
    """Lifecycle of monitoring conditions, which begin with an added occurrence."""
    return a.lifecycle(monitoring_events(spark, d), ["service", "operation"], opening="occurrence_added", rising="severity_changed")


GAPS = "SELECT *, state = 'bad' AS occurs, state IN ('good', 'baseline') AS ends, CASE WHEN state = 'baseline' THEN 'monitoring_interrupted' ELSE 'good_chunk' END AS reason FROM verdicts WHERE NOT historical"


@query(f"SELECT service, indicator, reason, {ALERT_SQL} FROM ({conditions_sql(GAPS, 'service, indicator')})")
def interrupted_alerts(spark: E, d: str) -> DataFrame:
    """Anomaly conditions that permanent gaps (here: baseline verdicts) end as well."""
    s = F.col("state")
    events = events_of(live(spark, d), s == "bad", s.isin("good", "baseline"), F.when(s == "baseline", "monitoring_interrupted").otherwise("good_chunk"))
    return a.conditions(events, SI).select(*SI, "reason", *ALERT_COLUMNS)


CLOSING = "CASE id % 51 WHEN 0 THEN 'monitoring_paused' WHEN 17 THEN 'service_removed' ELSE 'configuration_changed' END"
CLOSE = f"SELECT *, state = 'bad' AND id % 17 <> 0 AS occurs, state = 'good' OR id % 17 = 0 AS ends, CASE WHEN id % 17 = 0 THEN {CLOSING} ELSE 'good_chunk' END AS reason FROM verdicts WHERE NOT historical"


def closeout(spark: E, d: str) -> DataFrame:
    s, close = F.col("state"), F.expr("id % 17 = 0")
    events = events_of(live(spark, d), (s == "bad") & ~close, (s == "good") | close, F.when(close, F.expr(CLOSING)).otherwise("good_chunk"))
    return a.conditions(events, SI)


@query(f"SELECT service, indicator, reason, {ALERT_SQL} FROM ({conditions_sql(CLOSE, 'service, indicator')})")
def service_closeout(spark: E, d: str) -> DataFrame:
    """Conditions that a pause, removal or configuration change ends, with that reason."""
    return closeout(spark, d).select(*SI, "reason", *ALERT_COLUMNS)


# conditions of all kinds under one key, and what closes all of a service's
KINDS = ["kind", "service", "key"]
VIEWS["kind_events"] = f"""
SELECT 'anomaly' AS kind, service, CAST(indicator AS VARCHAR) AS key, us, id, occurs, ends, reason FROM ({ANOMALY})
UNION ALL SELECT 'monitoring', service, operation, us, id, occurs, ends, reason FROM ({MONITOR})
UNION ALL SELECT 'collection', CAST(service AS VARCHAR), '', us, id, failed, NOT failed, 'collection_recovered' FROM attempts WHERE kind <> 'signup'"""
VIEWS["service_closings"] = """
SELECT o_orderpriority AS service, epoch_us(o_orderdate) AS us, 1000000000 + o_orderkey AS id,
  CASE o_orderkey % 3 WHEN 0 THEN 'monitoring_paused' WHEN 1 THEN 'service_removed' ELSE 'configuration_changed' END AS reason FROM orders WHERE o_orderkey % 211 = 0
UNION ALL SELECT CAST(user_id AS VARCHAR), epoch_us(ts), 1000000000 + event_id, 'configuration_changed' FROM events WHERE event_type = 'signup'"""
WITH_CLOSINGS = """SELECT * FROM kind_events UNION ALL SELECT k.kind, k.service, k.key, c.us, c.id, false, true, c.reason
FROM service_closings c JOIN (SELECT DISTINCT kind, service, key FROM kind_events) k ON k.service = c.service"""


def kind_events(spark: E, d: str) -> DataFrame:
    """Events of anomaly, monitoring and collection conditions: kind, service, key, us, id, occurs, ends, reason."""
    failed = F.col("failed")
    tries = events_of(v.attempts(spark, d).where("kind <> 'signup'"), failed, ~failed, F.lit("collection_recovered"))
    parts = [("anomaly", anomaly_events(spark, d), F.col("indicator")), ("monitoring", monitoring_events(spark, d), F.col("operation")), ("collection", tries, F.lit(""))]
    columns = ["us", "id", "occurs", "ends", "reason"]
    out = [rows.select(F.lit(kind).alias("kind"), F.col("service").cast("string").alias("service"), key.cast("string").alias("key"), *columns) for kind, rows, key in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def service_closings(spark: E, d: str) -> DataFrame:
    """Pauses, removals and changes of services: some orders, and the sign-ups of users."""
    o, e = v.table(spark, d, "orders").where("o_orderkey % 211 = 0"), v.obs(spark, d).where("service = 'signup'")
    reason = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'monitoring_paused' WHEN 1 THEN 'service_removed' ELSE 'configuration_changed' END")
    orders = o.select(F.col("o_orderpriority").alias("service"), micros("o_orderdate").alias("us"), (1_000_000_000 + F.col("o_orderkey")).alias("id"), reason.alias("reason"))
    users = e.select(F.col("user_id").cast("string").alias("service"), "us", (1_000_000_000 + F.col("event_id")).alias("id"), F.lit("configuration_changed").alias("reason"))
    return orders.unionByName(users)


@query(f"SELECT kind, service, key, reason, {ALERT_SQL} FROM ({conditions_sql(WITH_CLOSINGS, 'kind, service, key')})")
def closeout_of_all_kinds(spark: E, d: str) -> DataFrame:
    """Conditions of all kinds, ended by their own events or by a closing of their service."""
    events = a.with_closings(kind_events(spark, d), service_closings(spark, d), KINDS)
    return a.conditions(events, KINDS).select(*KINDS, "reason", *ALERT_COLUMNS)


MESSAGE_SQL = "upper(left(replace(reason, '_', ' '), 1)) || substr(replace(reason, '_', ' '), 2)"


@query(f"SELECT reason, {MESSAGE_SQL} AS message, count(*) AS alerts FROM ({conditions_sql(CLOSE, 'service, indicator')}) WHERE reason IS NOT NULL GROUP BY reason")
def resolution_messages(spark: E, d: str) -> DataFrame:
    rows = closeout(spark, d).where("reason is not null")
    return rows.groupBy("reason", a.resolution_message(F.col("reason")).alias("message")).agg(F.count("*").alias("alerts"))


REQUESTS = "SELECT o_custkey AS service, epoch_us(o_orderdate) AS us, o_orderkey AS id, o_orderkey % 4 AS expected, o_orderstatus = 'O' AS accept FROM orders"


@query(
    f"""SELECT service, CAST(revision AS BIGINT) AS revision, override, CAST(applied AS BIGINT) AS applied, CAST(conflicts AS BIGINT) AS conflicts FROM (
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY us, id) AS n, count(*) OVER (PARTITION BY service) AS total FROM ({REQUESTS})),
f AS (
  SELECT service, total, 0 AS n, 0 AS revision, CAST(NULL AS BOOLEAN) AS override, 0 AS applied, 0 AS conflicts FROM r WHERE n = 1
  UNION ALL
  SELECT f.service, f.total, f.n + 1,
    f.revision + CASE WHEN f.override IS NOT DISTINCT FROM r.accept OR f.revision <> r.expected THEN 0 ELSE 1 END,
    CASE WHEN f.override IS NOT DISTINCT FROM r.accept OR f.revision <> r.expected THEN f.override ELSE r.accept END,
    f.applied + CASE WHEN f.override IS NOT DISTINCT FROM r.accept OR f.revision <> r.expected THEN 0 ELSE 1 END,
    f.conflicts + CASE WHEN f.override IS DISTINCT FROM r.accept AND f.revision <> r.expected THEN 1 ELSE 0 END
  FROM f JOIN r ON r.service = f.service AND r.n = f.n + 1)
SELECT * FROM f WHERE n = total)"""
)
def review_fold(spark: E, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").withColumn("us", v.micros("o_orderdate"))
    rows = o.select(F.col("o_custkey").alias("service"), "us", F.col("o_orderkey").alias("id"), F.expr("o_orderkey % 4").alias("expected"), (F.col("o_orderstatus") == "O").alias("accept"))
    return a.review_fold(rows, "service", ["us", "id"])


@query(
    """SELECT alert, accepted, occurrences, CASE WHEN accepted THEN 'accepted_as_normal' WHEN before THEN 'review_reverted' END AS reason,
  CASE WHEN accepted THEN 'resolved' WHEN before THEN 'firing' END AS status FROM (
  SELECT alert, bool_and(coalesce(review_override, false) AND id % 5 <> 1) AS accepted, bool_and(coalesce(review_override, false)) AS before, count(*) AS occurrences FROM hits GROUP BY alert)"""
)
def review_effects(spark: E, d: str) -> DataFrame:
    """Effects of reviews, of which every fifth is taken back again."""
    hits = a.occurrences(anomaly_events(spark, d), SI).withColumn("override_before", F.col("review_override"))
    return a.review_effects(hits.withColumn("review_override", F.when(F.expr("id % 5 <> 1"), F.col("review_override"))))


TAIL_SQL = "' (p-value ' || format('{:.6f}', p) || ', threshold 0.01).'"


@query(
    f"""SELECT service, w, 1 AS indicator, 'Response differs at this load' AS title,
  'The distribution is not that of the reference at load ' || format('{{:.6f}}', x) || {TAIL_SQL} AS description FROM analysis WHERE state = 'bad'
UNION ALL SELECT service, w, 2, 'Load differs at this time of day',
  'The distribution is not that of the reference at ' || format('{{:.0f}}', x) || ' seconds after midnight UTC' || {TAIL_SQL} FROM tanalysis WHERE state = 'bad'"""
)
def alert_text(spark: E, d: str) -> DataFrame:
    def text(rows: DataFrame, indicator: int) -> DataFrame:
        i = F.lit(indicator)
        return rows.where("state = 'bad'").select("service", "w", i.alias("indicator"), a.title(i).alias("title"), a.description(i, F.col("x"), F.col("p"), 0.01).alias("description"))

    return text(core.analysed(spark, d), 1).unionByName(text(core.tod_analysed(spark, d), 2))


@query(
    """SELECT a.service, a.w, round(a.p, 9) AS p, t.entries, round(t.mean, 9) AS mean, k.pts AS points FROM tanalysis a
JOIN (SELECT service, x AS level, count(*) AS pts FROM tpoints GROUP BY service, x) k ON k.service = a.service AND k.level = a.level
LEFT JOIN (SELECT w.service, w.w, count(*) AS entries, avg(o.value) AS mean FROM txs w JOIN obs o ON o.service = w.service AND o.us BETWEEN w.w - 300000000 AND w.w GROUP BY w.service, w.w) t
  ON t.service = a.service AND t.w = a.w
WHERE a.state IN ('good', 'bad')"""
)
def time_of_day_evidence(spark: E, d: str) -> DataFrame:
    """Trailing five minutes behind each tested window of the time-of-day model."""
    hits = core.tod_analysed(spark, d).where("state in ('good', 'bad')").select("service", "w", "points", "p")
    events = v.obs(spark, d).select("service", "us", F.col("value").alias("v"))
    last = ev.trailing(hits.select("service", "w", F.col("w").alias("at")), events, ["service"]).groupBy("service", "w")
    found = hits.join(last.agg(F.count("*").alias("entries"), F.avg("v").alias("mean")), v.KEY, "left")
    return found.select(*v.KEY, r9("p").alias("p"), "entries", r9("mean").alias("mean"), "points")


@query("SELECT alert, status, last_us FROM anomalies ORDER BY (status = 'firing') DESC, last_us DESC, alert DESC LIMIT 500")
def alert_list(spark: E, d: str) -> DataFrame:
    return a.ranked(a.conditions(anomaly_events(spark, d), SI)).select("alert", "status", "last_us")


@query(
    f"""SELECT alert, 'occurrence' AS kind, us, id, CAST(NULL AS VARCHAR) AS event FROM hits
UNION ALL SELECT alert, 'event', us, NULL, event FROM ({LIFE})"""
)
def alert_nested(spark: E, d: str) -> DataFrame:
    events = anomaly_events(spark, d)
    return a.nested(a.conditions(events, SI), a.occurrences(events, SI), a.lifecycle(events, SI))


@query(
    f"""SELECT service, indicator, alert FROM anomalies
WHERE status = 'firing' OR greatest(resolved_us, coalesce(CASE WHEN alert % 3 = 0 THEN resolved_us + (alert % 200) * {DAY} END, resolved_us)) >= {NOW} - 90 * {DAY}"""
)
def alert_retention(spark: E, d: str) -> DataFrame:
    rows = a.conditions(anomaly_events(spark, d), SI)
    reviewed = F.when(F.expr("alert % 3 = 0"), F.col("resolved_us") + F.expr("alert % 200") * DAY)
    return a.retained(rows.withColumn("reviewed_us", reviewed), NOW).select(*SI, "alert")


DETAILS = "'GET https://u:' || doc_id || '@h/api?token=' || doc_id || ' ' || text"
BLANKS_SQL = "".join(f" || chr({ord(c)})" for c in a.BLANKS).removeprefix(" || ")


def cut_sql(text: str, limit: int) -> str:
    """SQL of the longest beginning within ``limit`` bytes of a text, by the hexadecimal digits of its bytes."""
    inner = lambda at: f"substr(hex(encode({text})), {2 * at + 1}, 1) IN ('8', '9', 'A', 'B')"
    end = f"CASE WHEN NOT {inner(limit)} THEN {limit} WHEN NOT {inner(limit - 1)} THEN {limit - 1} WHEN NOT {inner(limit - 2)} THEN {limit - 2} ELSE {limit - 3} END"
    return f"CASE WHEN strlen({text}) <= {limit} THEN {text} ELSE decode(unhex(substr(hex(encode({text})), 1, 2 * ({end})))) END"


SHOWN_SQL = f"""
SELECT doc_id, text, string_agg(CASE WHEN k > 1 AND contains(part, '@') AND login <> '' AND NOT regexp_matches(login, '[/ \t\n\f\r]') THEN '[redacted]' || substr(part, length(login) + 1) ELSE part END, '://' ORDER BY k) AS shown FROM (
  SELECT doc_id, text, k, part, string_split(part, '@')[1] AS login FROM (
    SELECT doc_id, text, unnest(string_split(shown, '://')) AS part, generate_subscripts(string_split(shown, '://'), 1) AS k FROM (
      SELECT doc_id, any_value(text) AS text, string_agg(CASE WHEN contains(lower(line), 'authorization:') AND ltrim(split_part(lower(line), 'authorization:', 2), ' ') <> '' THEN
          left(line, position('authorization:' IN lower(line)) + 13) || '[redacted]' ELSE line END, chr(10) ORDER BY l) AS shown FROM (
        SELECT doc_id, l, any_value(text) AS text, string_agg(CASE WHEN hit IS NULL THEN item ELSE array_to_string(list_slice(string_split(item, '='), 1, hit), '=') || '=[redacted]' END || sep, '' ORDER BY k) AS line FROM (
          SELECT *, list_min(list_filter(range(1, len(string_split(item, '='))), lambda j: ({{named}}) AND (len(string_split(item, '=')) - j > 1 OR string_split(item, '=')[j + 1] <> ''))) AS hit FROM (
            SELECT doc_id, text, l, unnest(regexp_split_to_array(line, '[ &\t\f\r]')) AS item, generate_subscripts(regexp_split_to_array(line, '[ &\t\f\r]'), 1) AS k, unnest(list_append(regexp_extract_all(line, '[ &\t\f\r]'), '')) AS sep FROM (
              SELECT doc_id, text, unnest(string_split(details, chr(10))) AS line, generate_subscripts(string_split(details, chr(10)), 1) AS l
              FROM (SELECT doc_id, text, trim({DETAILS}, {BLANKS_SQL}) AS details FROM documents))))
        GROUP BY doc_id, l)
      GROUP BY doc_id)))
GROUP BY doc_id, text"""
SHOWN_SQL = SHOWN_SQL.replace("{named}", " OR ".join(f"ends_with(lower(string_split(item, '=')[j]), '{n}')" for n in a.SECRET_NAMES))


@query(f"SELECT doc_id, {cut_sql('shown', 4000)} AS details, {cut_sql('text', 2000)} AS error FROM ({SHOWN_SQL})")
def sanitize_details(spark: E, d: str) -> DataFrame:
    """Details as an alert shows them, and the error text as the backlog keeps it."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("GET https://u:"), i, F.lit("@h/api?token="), i, F.lit(" "), F.col("text"))
    return v.table(spark, d, "documents").select("doc_id", a.redacted(text).alias("details"), a.cut_bytes(F.col("text"), 2000).alias("error"))


@query(
    """SELECT service, indicator, round(count(*) FILTER (p AND a) / nullif(count(*) FILTER (p), 0), 9) AS "precision", round(count(*) FILTER (p AND a) / nullif(count(*) FILTER (a), 0), 9) AS recall,
  round(count(*) FILTER (a) / count(*), 9) AS prevalence, round(count(*) FILTER (p = a) / count(*), 9) AS accuracy
FROM (SELECT v.service, v.indicator, v.state = 'bad' AS p, o.o_orderstatus = 'F' AS a FROM verdicts v JOIN orders o ON o.o_orderkey = v.id) GROUP BY service, indicator"""
)
def alert_quality(spark: E, d: str) -> DataFrame:
    truth = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("actual"))
    rows = v.verdicts(spark, d).join(truth, "id").withColumn("predicted", F.col("state") == "bad")
    return a.quality(rows, SI).select(*SI, *[r9(c).alias(c) for c in ("precision", "recall", "prevalence", "accuracy")])


# --- evidence ----------------------------------------------------------------------------------------------------


def bad(spark: E, d: str) -> DataFrame:
    return core.analysed(spark, d).where("state = 'bad'").select("service", "w", "level", "p")


@query(
    """SELECT a.service, a.w, round(a.p, 9) AS p, y.total, y.entries, round(y.mean, 9) AS mean, k.pts AS points, t.trailing, 'available' AS status FROM analysis a
JOIN (SELECT service, w, CAST(sum(c) AS BIGINT) AS total, count(*) AS entries, sum(v * c) / sum(c) AS mean FROM ys GROUP BY service, w) y USING (service, w)
JOIN (SELECT service, x AS level, count(*) AS pts FROM points GROUP BY service, x) k ON k.service = a.service AND k.level = a.level
LEFT JOIN (SELECT service, w, count(*) AS trailing FROM win WHERE us >= w - 300000000 GROUP BY service, w) t ON t.service = a.service AND t.w = a.w
WHERE a.state = 'bad'"""
)
def alert_evidence(spark: E, d: str) -> DataFrame:
    points = model.conditional_points(v.published(spark, d), v.MODEL)
    hits = bad(spark, d)
    out = ev.evidence(hits, v.score_samples(spark, d), points, v.KEY)
    events = v.obs(spark, d).select("service", "us", F.col("value").alias("v"))
    last = ev.trailing(hits.select("service", "w", F.col("w").alias("at")), events, ["service"]).groupBy("service", "w").agg(F.count("*").alias("trailing"))
    return out.join(last, v.KEY, "left").select(*v.KEY, r9("p").alias("p"), "total", "entries", r9("mean").alias("mean"), "points", "trailing", "status")


@query(
    """SELECT a.service, a.w, 'expected' AS series, round(p.v, 9) AS v, round(p.p, 9) AS p FROM analysis a JOIN points p ON p.service = a.service AND p.x = a.level WHERE a.state = 'bad'
UNION ALL SELECT y.service, y.w, 'actual', round(y.v, 9), round(sum(y.c) OVER (PARTITION BY y.service, y.w ORDER BY y.v) / sum(y.c) OVER (PARTITION BY y.service, y.w), 9)
FROM ys y JOIN analysis a USING (service, w) WHERE a.state = 'bad'"""
)
def cdf_comparison(spark: E, d: str) -> DataFrame:
    hits = bad(spark, d)
    points = model.conditional_points(v.published(spark, d), v.MODEL).withColumnRenamed("x", "level")
    expected = hits.join(points.withColumnRenamed("p", "q"), ["service", "level"]).select(*v.KEY, "v", F.col("q").alias("p"))
    actual = v.score_samples(spark, d).join(hits, v.KEY, "left_semi")
    return ev.comparison(expected, actual, v.KEY).select(*v.KEY, "series", r9("v").alias("v"), r9("p").alias("p"))


MINUTE = 60_000_000
#: One service's configuration changed late; chunks of some windows were deleted.
STALE = "service = 'view'"
DELETED = "(w // 21600000000) % 7 = 3"
HISTORICAL = "(w // 21600000000) % 5 = 0"


@query(
    f"""SELECT * FROM (WITH o AS (SELECT service, 1 AS indicator, w, p FROM analysis WHERE state = 'bad' UNION ALL SELECT service, 2, w, p FROM tanalysis WHERE state IN ('good', 'bad')),
c AS (SELECT service, 1 AS indicator, w, x, w AS t0 FROM xs UNION ALL SELECT service, 2, m, (m // 1000000) % 86400, m FROM (SELECT DISTINCT service, (us + {MINUTE} - 1) // {MINUTE} * {MINUTE} AS m FROM obs)
  UNION SELECT service, 2, w, (w // 1000000) % 86400, w FROM txs),
s AS (SELECT service, 1 AS indicator, w, v, c FROM ys UNION ALL SELECT service, 2, m, value, count(*) FROM (SELECT service, (us + {MINUTE} - 1) // {MINUTE} * {MINUTE} AS m, value FROM obs) GROUP BY 1, 3, 4),
l AS (SELECT o.* FROM o WHERE NOT {HISTORICAL}),
n AS (SELECT l.service, l.indicator, l.w AS t0, c.w, c.x FROM l JOIN c ON c.service = l.service AND c.indicator = l.indicator AND c.w <= l.w AND c.w >= l.w - CASE l.indicator WHEN 2 THEN 300000000 ELSE 0 END
  WHERE NOT (l.{STALE}) AND NOT (l.w // 21600000000) % 7 = 3 AND NOT (c.w % 21600000000 = 0 AND (c.w // 21600000000) % 7 = 3)),
i AS (SELECT service, indicator, t0, count(*) AS chunks, avg(x) AS x FROM n GROUP BY ALL),
g AS (SELECT n.service, n.indicator, n.t0, s.v, sum(s.c) AS c FROM n JOIN s ON s.service = n.service AND s.indicator = n.indicator AND s.w = n.w GROUP BY ALL),
h AS (SELECT service, indicator, t0, count(*) AS entries, CAST(sum(c) AS BIGINT) AS total, sum(v * c) / sum(c) AS mean FROM g GROUP BY ALL),
k AS (SELECT 1 AS indicator, service, x, count(*) AS pts FROM points GROUP BY ALL UNION ALL SELECT 2, service, x, count(*) FROM tpoints GROUP BY ALL),
f AS (SELECT i.*, h.entries, h.total, h.mean, coalesce(k.x, z.x) AS level, coalesce(k.pts, z.pts) AS points FROM i JOIN h USING (service, indicator, t0)
  ASOF LEFT JOIN k ON k.service = i.service AND k.indicator = i.indicator AND i.x >= k.x
  LEFT JOIN (SELECT service, indicator, min(x) AS x, arg_min(pts, x) AS pts FROM k GROUP BY ALL) z ON z.service = i.service AND z.indicator = i.indicator)
SELECT l.service, CAST(l.indicator AS INTEGER) AS indicator, l.w, round(l.p, 9) AS p, f.chunks, round(f.x, 9) AS x, f.entries, f.total, round(f.mean, 9) AS mean, f.level, f.points,
  CASE WHEN f.level IS NULL THEN 'gone' ELSE 'available' END AS status
FROM l LEFT JOIN f ON f.service = l.service AND f.indicator = l.indicator AND f.t0 = l.w)"""
)
def occurrence_evidence(spark: E, d: str) -> DataFrame:
    """Evidence of live occurrences of both indicators; for time of day the minutes of the last five, merged."""
    both = lambda a, b: a.withColumn("indicator", F.lit(1)).unionByName(b.withColumn("indicator", F.lit(2)))
    bad_, tested = bad(spark, d).select(*v.KEY, "p"), core.tod_analysed(spark, d).where("state in ('good', 'bad')").select(*v.KEY, "p")
    found = both(bad_, tested).withColumn("historical", F.expr(HISTORICAL.replace("//", "div")))
    minutes = windows.assign(v.obs(spark, d), MINUTE)
    ends = minutes.select(*v.KEY).union(found.where("indicator = 2").select(*v.KEY)).distinct().withColumn("x", samples.time_of_day("w").cast("double"))
    chunks = both(v.xs(spark, d), ends).withColumn("generation", F.lit(1).cast("long")).where(f"not (w % {v.WINDOW} = 0 and {DELETED.replace('//', 'div')})")
    y = both(v.ys(spark, d), samples.count_samples(minutes, v.KEY))
    services = v.obs(spark, d).select("service").distinct().withColumn("generation", F.when(F.expr(STALE), 2).otherwise(1).cast("long"))
    mass = both(v.published(spark, d), v.tod_mass(spark, d)).withColumn("generation", F.lit(1).cast("long"))
    out = ev.behind(found, stored(chunks, "chunks"), stored(y, "samples"), services, mass, {2: ev.TRAIL})
    return out.select("service", "indicator", "w", r9("p").alias("p"), "chunks", r9("x").alias("x"), "entries", "total", r9("mean").alias("mean"), "level", "points", "status")


ISO_SQL = "strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%SZ')"
BOTH_SQL = "SELECT service, w, 1 AS indicator, x, p FROM analysis WHERE state = 'bad' UNION ALL SELECT service, w, 2, x, p FROM tanalysis WHERE state = 'bad'"


@query(
    f"""SELECT 'chunk:' || service || ':' || indicator || ':' || w AS key,
  CASE indicator WHEN 1 THEN 'Response differs at this load' ELSE 'Load differs at this time of day' END || ' at ' || {ISO_SQL.format(us='w')} AS summary,
  '{{"independentValue":' || format('{{:.6f}}', x) || ',"pValue":' || format('{{:.9f}}', p) || ',"threshold":0.01,"historical":' || CASE WHEN {HISTORICAL} THEN 'true' ELSE 'false' END || '}}' AS evidence,
  CASE WHEN {HISTORICAL} THEN 'Behaviour in the past was unusual; that says nothing about the service now.'
    WHEN indicator = 1 THEN 'Responses at this load are unlike those that the reference was learned from.' ELSE 'Load is unlike what the service has at this time of day.' END AS impact,
  'Look at the service and the windows listed; accept a window as normal only if it is expected behaviour.' AS action
FROM ({BOTH_SQL})"""
)
def occurrence_records(spark: E, d: str) -> DataFrame:
    """Occurrences as they are recorded: key, summary, evidence, impact and what to do."""
    part = lambda rows, i: rows.where("state = 'bad'").select("service", "w", F.lit(i).alias("indicator"), "x", "p", F.col("w").alias("us"), F.col("w").alias("id"))
    rows = part(core.analysed(spark, d), 1).unionByName(part(core.tod_analysed(spark, d), 2))
    found = a.unique_occurrences(rows, ["service", "indicator", "us"]).withColumn("historical", F.expr(HISTORICAL.replace("//", "div")))
    i, past = F.col("indicator"), F.col("historical")
    return found.select("key", a.summary(i, "w").alias("summary"), a.evidence_json(F.col("x"), F.col("p"), 0.01, past).alias("evidence"), a.impact(i, past).alias("impact"), a.action().alias("action"))


RETRY_SQL = "last_us + 1000000 * CAST(least(pow(2, least(occurrences - 1, 10)), 60) AS BIGINT)"


@query(
    f"""SELECT service, alert, 'Metrics of ' || service || ' could not be collected: ' || occurrences || ' consecutive attempts failed.'
  || CASE WHEN status = 'firing' THEN ' Next attempt at ' || {ISO_SQL.format(us=RETRY_SQL)} || '.' ELSE '' END AS description FROM ({conditions_sql(ATTEMPTS, 'service')})"""
)
def collection_text(spark: E, d: str) -> DataFrame:
    """Text of collection failures, with the time of the next attempt while they last."""
    failed = F.col("failed")
    rows = a.conditions(events_of(v.attempts(spark, d), failed, ~failed, F.lit("collection_recovered")), ["service"])
    wait = F.least(F.pow(F.lit(2.0), F.least(F.col("occurrences") - 1, F.lit(10))), F.lit(60.0)).cast("long")
    rows = rows.withColumn("retry_us", F.when(F.col("status") == "firing", F.col("last_us") + 1_000_000 * wait))
    return rows.select("service", "alert", a.collection_text(F.col("service").cast("string"), F.col("occurrences"), "retry_us").alias("description"))


def with_payload(rows: DataFrame) -> DataFrame:
    return rows.withColumn("payload", F.concat_ws(":", F.col("part").cast("string"), F.col("line").cast("string")))


@query(
    """SELECT f.alert, 'resolved' AS operation, f.severity, f.payload, r.us FROM (
  SELECT alert, severity, arg_max(part || ':' || line, lpad(us::VARCHAR, 20, '0') || lpad(line::VARCHAR, 4, '0') || lpad(part::VARCHAR, 12, '0')) AS payload
  FROM deliveries WHERE operation = 'firing' AND state = 'delivered' GROUP BY alert, severity) f
JOIN (SELECT alert, max(us) AS us FROM deliveries WHERE operation = 'resolved' GROUP BY alert) r ON r.alert = f.alert"""
)
def delivered_resolutions(spark: E, d: str) -> DataFrame:
    """Resolutions of the severities of ended alerts that were delivered, with the payload delivered last."""
    rows = with_payload(v.deliveries(spark, d))
    ended = rows.where("operation = 'resolved'").groupBy("alert").agg(F.max("us").alias("ended_us"))
    return notify.resolutions(rows, ended, ["us", "line", "part"])


LEVEL = ["service", "level"]


def expected_pieces(spark: E, d: str) -> tuple[DataFrame, DataFrame]:
    """The bad windows, and the density pieces of the levels behind them, each level's once."""
    hits = stored(bad(spark, d).select("service", "w", "level"), "bad")
    points = model.conditional_points(v.published(spark, d), v.MODEL).withColumnRenamed("x", "level")
    return hits, ev.pieces(points.join(hits.select(*LEVEL).distinct(), LEVEL, "left_semi"), LEVEL)


VIEWS["rises"] = """
SELECT *, (p2 - p) / (x2 - x1) AS rise FROM (
  SELECT a.service, a.w, CAST(row_number() OVER o - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY a.service, a.w) AS n, c.v AS x1, lead(c.v) OVER o AS x2, c.p, lead(c.p) OVER o AS p2
  FROM analysis a JOIN points c ON c.service = a.service AND c.x = a.level
  WHERE a.state = 'bad' WINDOW o AS (PARTITION BY a.service, a.w ORDER BY c.v))
WHERE i < n - 1"""
VIEWS["forward"] = """
SELECT r.*, CASE WHEN r.i > r.n - 3 THEN f.raw WHEN r.rise = 0 THEN 0 ELSE least(greatest(f.raw, 0), 2 * r.rise) END AS m FROM (
  WITH RECURSIVE f AS (
    SELECT service, w, 0 AS i, CAST(0 AS DOUBLE) AS raw FROM rises WHERE i = 0
    UNION ALL SELECT f.service, f.w, f.i + 1, CASE WHEN r.rise = 0 THEN 0 ELSE 2 * r.rise - least(greatest(f.raw, 0), 2 * r.rise) END
    FROM f JOIN rises r ON r.service = f.service AND r.w = f.w AND r.i = f.i WHERE f.i < r.n - 2)
  SELECT * FROM f) f JOIN rises r ON r.service = f.service AND r.w = f.w AND r.i = f.i"""
VIEWS["slopes"] = """
SELECT service, w, CAST(i + 1 AS INTEGER) AS i, fixed AS m FROM (
  WITH RECURSIVE b AS (
    SELECT service, w, CAST(n - 1 AS INTEGER) AS i, CAST(NULL AS DOUBLE) AS fixed, CAST(0 AS DOUBLE) AS cur FROM forward WHERE i = 0
    UNION ALL SELECT b.service, b.w, b.i - 1, CASE WHEN r.rise = 0 THEN b.cur ELSE least(b.cur, 2 * r.rise) END,
      CASE WHEN r.rise = 0 THEN r.m ELSE least(r.m, 2 * r.rise - least(b.cur, 2 * r.rise)) END
    FROM b JOIN forward r ON r.service = b.service AND r.w = b.w AND r.i = b.i - 1 WHERE b.i > 1)
  SELECT service, w, i, fixed FROM b WHERE fixed IS NOT NULL
  UNION ALL SELECT service, w, 0, cur FROM b WHERE i = 1)
UNION ALL SELECT service, w, 0, m FROM forward WHERE i = 0"""
VIEWS["pieces"] = """
SELECT r.service, r.w, r.i, r.x1, r.x2, r.rise, CASE WHEN r.rise <> 0 THEN a.m / r.rise END AS m0, CASE WHEN r.rise <> 0 THEN b.m / r.rise END AS m1
FROM rises r JOIN slopes a ON a.service = r.service AND a.w = r.w AND a.i = r.i JOIN slopes b ON b.service = r.service AND b.w = r.w AND b.i = r.i + 1"""


@query("SELECT service, w, i, x1, x2, round(rise, 9) AS rise, round(m0, 9) AS m0, round(m1, 9) AS m1 FROM pieces")
def cdf_density(spark: E, d: str) -> DataFrame:
    """Density pieces of the reference behind each bad window."""
    hits, pieces = expected_pieces(spark, d)
    return hits.join(pieces, LEVEL).select(*v.KEY, "i", "x1", "x2", *[r9(c).alias(c) for c in ("rise", "m0", "m1")])


DENSITY = "5 * (6 - 3 * m0 - 3 * m1) * pow(t, 4) + 4 * (-15 + 8 * m0 + 7 * m1) * pow(t, 3) + 3 * (10 - 6 * m0 - 4 * m1) * t * t + m0"


@query(
    f"""SELECT service, w, step, round(x, 9) AS x, round(CASE WHEN rise IS NULL OR rise = 0 THEN 0 ELSE greatest(0, rise * ({DENSITY})) END, 9) AS density FROM (
  SELECT k.*, p.rise, p.m0, p.m1, (k.x - p.x1) / (p.x2 - p.x1) AS t FROM (
    SELECT service, w, CAST(step AS INTEGER) AS step, CASE step WHEN 0 THEN lo WHEN 64 THEN hi ELSE lo * exp(step / 64 * ln(hi / lo)) END AS x
    FROM (SELECT service, w, min(x1) AS lo, max(x2) AS hi FROM pieces GROUP BY service, w), generate_series(0, 64) g(step)) k
  LEFT JOIN pieces p ON p.service = k.service AND p.w = k.w AND k.x <= p.x2 AND (k.x > p.x1 OR (p.i = 0 AND k.x = p.x1)))"""
)
def density_samples(spark: E, d: str) -> DataFrame:
    """That density at 65 points, evenly spaced in the logarithm."""
    hits, pieces = expected_pieces(spark, d)
    bounds = pieces.groupBy(*LEVEL).agg(F.min("x1").alias("lo"), F.max("x2").alias("hi"))
    return hits.join(ev.sampled_density(pieces, bounds, LEVEL, 64), LEVEL).select(*v.KEY, "step", r9("x").alias("x"), r9("density").alias("density"))


# --- notifications -----------------------------------------------------------------------------------------------


@query(
    """SELECT alert, 'firing' AS operation, CASE WHEN n >= 3 THEN 'critical' ELSE 'warning' END AS severity, us FROM hits
UNION ALL SELECT alert, 'resolved', 'warning', us FROM hits WHERE n = 3
UNION ALL SELECT alert, 'resolved', 'warning', resolved_us FROM anomalies WHERE status = 'resolved'
UNION ALL SELECT alert, 'resolved', 'critical', resolved_us FROM anomalies WHERE status = 'resolved' AND occurrences >= 3"""
)
def notification_plan(spark: E, d: str) -> DataFrame:
    events = anomaly_events(spark, d)
    return notify.plan(a.occurrences(events, SI), a.conditions(events, SI))


@query(
    """SELECT alert, operation, us, '{"alertId":' || alert || ',"service":"' || service || '","indicator":"' || indicator || '","alertName":"anomaly","severity":"' || severity
  || '","labels":{"alert_id":"' || alert || '","alert_type":"anomaly"}}' AS payload FROM (
  SELECT alert, service, indicator, 'firing' AS operation, CASE WHEN n >= 3 THEN 'critical' ELSE 'warning' END AS severity, us FROM hits
  UNION ALL SELECT alert, service, indicator, 'resolved', 'warning', us FROM hits WHERE n = 3
  UNION ALL SELECT alert, service, indicator, 'resolved', 'warning', resolved_us FROM anomalies WHERE status = 'resolved'
  UNION ALL SELECT alert, service, indicator, 'resolved', 'critical', resolved_us FROM anomalies WHERE status = 'resolved' AND occurrences >= 3)"""
)
def notification_payload(spark: E, d: str) -> DataFrame:
    """The planned notifications with their bodies."""
    events = anomaly_events(spark, d)
    alerts = a.conditions(events, SI)
    rows = notify.plan(a.occurrences(events, SI), alerts).join(alerts.select("alert", *SI), "alert")
    body = notify.payload(F.col("alert"), F.col("service"), F.col("indicator"), F.lit("anomaly"), F.col("severity"))
    return rows.select("alert", "operation", "us", body.alias("payload"))


@query(
    """SELECT alert, delivered, pending, missed, CASE WHEN delivered > 0 THEN 'delivered' WHEN done OR pending = 0 THEN 'missed' ELSE 'pending' END AS state FROM (
  SELECT alert, count(*) FILTER (now = 'delivered') AS delivered, count(*) FILTER (now = 'pending') AS pending, count(*) FILTER (now = 'missed') AS missed, bool_or(done) AS done
  FROM (SELECT f.alert, r.alert IS NOT NULL AS done, CASE WHEN f.state = 'pending' AND r.alert IS NOT NULL THEN 'missed' ELSE f.state END AS now
    FROM deliveries f LEFT JOIN (SELECT DISTINCT alert FROM deliveries WHERE operation = 'resolved') r ON r.alert = f.alert WHERE f.operation = 'firing') GROUP BY alert)"""
)
def notification_state(spark: E, d: str) -> DataFrame:
    rows = v.deliveries(spark, d)
    return notify.states(rows, rows.where("operation = 'resolved'"))


@query(f"SELECT alert, line, part, us FROM deliveries WHERE state = 'pending' AND us <= {NOW}")
def notifications_due(spark: E, d: str) -> DataFrame:
    return notify.due(v.deliveries(spark, d), NOW).select("alert", "line", "part", "us")


@query("SELECT alert, line, part, us + 1000000 * CAST(least(pow(2, attempts), 300) AS BIGINT) AS next_us FROM deliveries WHERE state = 'missed'")
def retry_backoff(spark: E, d: str) -> DataFrame:
    rows = v.deliveries(spark, d).where("state = 'missed'")
    return rows.select("alert", "line", "part", (F.col("us") + 1_000_000 * notify.retry_s(F.col("attempts"))).alias("next_us"))


@query(
    f"""SELECT alert, severity, payload, handed_us FROM (
  SELECT alert, arg_max(part || ':' || line, lpad(us::VARCHAR, 20, '0') || lpad(line::VARCHAR, 4, '0') || lpad(part::VARCHAR, 12, '0') || severity) AS payload,
    arg_max(severity, lpad(us::VARCHAR, 20, '0') || lpad(line::VARCHAR, 4, '0') || lpad(part::VARCHAR, 12, '0') || severity) AS severity, max(us) FILTER (state = 'delivered') AS handed_us
  FROM deliveries WHERE operation = 'firing' GROUP BY alert)
WHERE alert NOT IN (SELECT alert FROM deliveries WHERE operation = 'resolved') AND (handed_us IS NULL OR handed_us < {NOW} - 120000000)
  AND alert NOT IN (SELECT alert FROM deliveries WHERE state = 'pending')"""
)
def stale_handoffs(spark: E, d: str) -> DataFrame:
    """Alerts to hand on again, with the latest payload."""
    rows = with_payload(v.deliveries(spark, d))
    ended = rows.where("operation = 'resolved'").select("alert").distinct()
    return notify.stale(rows, rows.join(ended, "alert", "left_anti"), NOW, ["us", "line", "part"], also=["payload"]).select("alert", "severity", "payload", "handed_us")

