"""Alert conditions and their lifecycle.

A condition is folded in event-time order: occurrences between two ending
events make one alert. Numbering the stretches between ends needs a running
count over a key's events; it is taken over bounded stretches of time and then
over the stretches, so one busy key does not fall to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condist.functions.stats import severity
from condist.functions.times import DAY, moment

STRETCH = 30 * DAY


def numbered(events: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """``island``: how many ending events (``ends``) of the key come before the row by (us, id)."""
    rows = events.withColumn("_s", F.floor(F.col("us") / stretch)).withColumn("_e", F.when(F.col("ends"), 1).otherwise(0))
    inside = Window.partitionBy(*keys, "_s").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_s").agg(F.sum("_e").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_s", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    run = rows.withColumn("_r", F.coalesce(F.sum("_e").over(inside), F.lit(0))).join(carried, [*keys, "_s"])
    return run.withColumn("island", F.col("_r") + F.col("_b")).drop("_s", "_e", "_r", "_b")


def conditions(events: DataFrame, keys: list[str], threshold: int = 3) -> DataFrame:
    """Alerts from events (us, id, occurs, ends, reason): alert (id of the first occurrence), started_us, last_us,
    occurrences, severity, status, resolved_us and reason of the event that ended it."""
    rows = numbered(events, keys)
    hit = F.col("occurs")
    out = rows.groupBy(*keys, "island").agg(
        F.min_by(F.when(hit, F.col("id")), F.when(hit, F.struct("us", "id"))).alias("alert"),
        F.min(F.when(hit, F.col("us"))).alias("started_us"),
        F.max(F.when(hit, F.col("us"))).alias("last_us"),
        F.count_if(hit).alias("occurrences"),
        F.max(F.when(F.col("ends"), F.col("us"))).alias("resolved_us"),
        F.max(F.when(F.col("ends"), F.col("reason"))).alias("reason"),
    )
    alerts = out.where("occurrences > 0").withColumn("severity", severity(F.col("occurrences"), threshold))
    return alerts.withColumn("status", F.when(F.col("resolved_us").isNull(), "firing").otherwise("resolved"))


def occurrences(events: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """Occurrences with their alert (the id of its first one) and their number in it, from 1.

    Numbers are counts in a stretch of time and
    those of the alert's stretches before, so an alert that does not end is no
    single task.
    """
    key = [*keys, "island", "_s"]
    rows = numbered(events, keys, stretch).where("occurs").withColumn("_s", F.floor(F.col("us") / stretch))
    own = Window.partitionBy(*key).orderBy("us", "id")
    sums = rows.groupBy(*key).agg(F.count("*").alias("_t"), F.min(F.struct("us", "id")).alias("_f"))
    over = Window.partitionBy(*keys, "island").orderBy("_s")
    before = F.coalesce(F.sum("_t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("_f").over(over.rowsBetween(Window.unboundedPreceding, 0))
    carried = sums.select(*key, before.alias("_b"), first["id"].alias("alert"))
    out = rows.withColumn("_n", F.row_number().over(own)).join(carried, key)
    return out.withColumn("n", F.col("_n") + F.col("_b")).drop("_s", "_n", "_b")


def lifecycle(events: DataFrame, keys: list[str], threshold: int = 3, opening: str = "opened", rising: str = "escalated") -> DataFrame:
    """Events of each alert: ``opening`` or occurrence_added, ``rising`` when the count is the threshold, resolved."""
    hits = occurrences(events, keys)
    first = F.when(F.col("n") == 1, opening).otherwise("occurrence_added")
    types = F.array_compact(F.array(first, F.when(F.col("n") == threshold, rising)))
    added = hits.select(*keys, "alert", "us", F.explode(types).alias("event"))
    ended = conditions(events, keys, threshold).where("status = 'resolved'")
    return added.unionByName(ended.select(*keys, "alert", F.col("resolved_us").alias("us"), F.lit("resolved").alias("event")))


def with_closings(events: DataFrame, closings: DataFrame, keys: list[str], service: str = "service") -> DataFrame:
    """Events of any kinds of condition and, as ending events of every condition of their service, its closings (service, us, id, reason).

    A pause, a removal or a change of configuration so ends all conditions of
    the service, whatever their kind. ``keys`` hold the service's column.
    """
    every = closings.join(events.select(*keys).distinct(), service)
    ends = every.select(*keys, "us", "id", F.lit(False).alias("occurs"), F.lit(True).alias("ends"), "reason")
    return events.select(*keys, "us", "id", "occurs", "ends", "reason").unionByName(ends)


def unique_occurrences(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row (that of the least id) for each occurrence key ``chunk:service:indicator:us``."""
    w = Window.partitionBy(*keys).orderBy("id")
    name = F.concat_ws(":", F.lit("chunk"), *[F.col(k).cast("string") for k in keys])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("key", name)


def review_fold(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """State of each occurrence after its review requests (expected, accept), in order.

    A request for the decision that stands changes nothing; one that expects
    another revision conflicts; any other sets the override and adds one to
    the revision.
    """
    per = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "expected", "accept"))).alias("r"))
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.lit(None).cast("boolean").alias("override"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("conflicts"))

    def step(s: Column, r: Column) -> Column:
        same = s["override"].eqNullSafe(r["accept"])
        stale = ~same & (s["revision"] != r["expected"])
        change = ~same & ~stale
        return F.struct(
            F.when(change, s["revision"] + 1).otherwise(s["revision"]).alias("revision"),
            F.when(change, r["accept"]).otherwise(s["override"]).alias("override"),
            F.when(change, s["applied"] + 1).otherwise(s["applied"]).alias("applied"),
            F.when(stale, s["conflicts"] + 1).otherwise(s["conflicts"]).alias("conflicts"),
        )

    return per.select(key, F.aggregate("r", start, step).alias("s")).select(key, "s.*")


def review_effects(occurrences: DataFrame) -> DataFrame:
    """By alert: whether all occurrences are accepted, and what follows.

    Acceptance of all resolves the alert. If all were accepted before
    (``override_before``) and a review took that back, it fires again.
    """
    all_ = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    out = occurrences.groupBy("alert").agg(all_("review_override").alias("accepted"), all_("override_before").alias("before"), F.count("*").alias("occurrences"))
    reason = F.when(F.col("accepted"), "accepted_as_normal").when(F.col("before"), "review_reverted")
    status = F.when(F.col("accepted"), "resolved").when(F.col("before"), "firing")
    return out.select("alert", "accepted", "occurrences", reason.alias("reason"), status.alias("status"))


def resolution_message(reason: Column) -> Column:
    """Message of a resolution reason, made from its code: its words, with a capital at the start."""
    words = F.replace(reason, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def title(indicator: Column) -> Column:
    return F.when(indicator == 1, "Response differs at this load").when(indicator == 2, "Load differs at this time of day").otherwise("Unusual behaviour")


def description(indicator: Column, x: Column, p: Column, threshold: float) -> Column:
    """What differed, with the driver's value and the test's p-value."""
    at = F.when(indicator == 1, F.format_string("load %.6f", x)).otherwise(F.format_string("%.0f seconds after midnight UTC", x))
    return F.concat(F.lit("The distribution is not that of the reference at "), at, F.format_string(" (p-value %.6f, threshold %.2f).", p, F.lit(threshold)))


def impact(indicator: Column, historical: Column) -> Column:
    """What an anomaly means for the service."""
    past = F.lit("Behaviour in the past was unusual; that says nothing about the service now.")
    now = F.when(indicator == 1, "Responses at this load are unlike those that the reference was learned from.").when(
        indicator == 2, "Load is unlike what the service has at this time of day."
    )
    return F.when(historical, past).otherwise(now.otherwise("The service behaves unlike the reference."))


def action() -> Column:
    return F.lit("Look at the service and the windows listed; accept a window as normal only if it is expected behaviour.")


def summary(indicator: Column, us: str) -> Column:
    """An occurrence in one line: its alert's title and when it was."""
    return F.concat(title(indicator), F.lit(" at "), F.date_format(moment(us), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def collection_text(service: Column, failures: Column, retry_us: str) -> Column:
    """Text of a collection failure: how many attempts in a row failed and, where it is known, when the next one is."""
    first = F.format_string("Metrics of %s could not be collected: %d consecutive attempts failed.", service, failures)
    again = F.concat(F.lit(" Next attempt at "), F.date_format(moment(retry_us), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("."))
    return F.concat(first, F.coalesce(again, F.lit("")))


def evidence_json(x: Column, p: Column, threshold: float, historical: Column) -> Column:
    """An occurrence's evidence: the driver's value, the p-value, the threshold, whether it is historical."""
    fields = {"independentValue": F.format_string("%.6f", x), "pValue": F.format_string("%.9f", p), "threshold": F.lit(f"{threshold:g}"), "historical": historical.cast("string")}
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), c) for k, c in fields.items()]), F.lit("}"))


def ranked(alerts: DataFrame, limit: int = 500, resolved: bool = True) -> DataFrame:
    """The first ``limit`` alerts: firing first, then the latest; 0 gives none."""
    rows = alerts if resolved else alerts.where("status = 'firing'")
    return rows.orderBy(F.desc(F.col("status") == "firing"), F.desc("last_us"), F.desc("alert")).limit(limit)


def nested(alerts: DataFrame, hits: DataFrame, events: DataFrame) -> DataFrame:
    """The occurrences and events of the alerts as rows: alert, kind, us, id (of an occurrence), event; newest first within an alert."""
    o = hits.select("alert", F.lit("occurrence").alias("kind"), "us", "id", F.lit(None).cast("string").alias("event"))
    e = events.select("alert", F.lit("event").alias("kind"), "us", F.lit(None).cast("long").alias("id"), "event")
    return o.unionByName(e).join(alerts.select("alert"), "alert", "left_semi").orderBy("alert", F.desc("us"), F.desc("id"), F.desc("event"))


def retained(alerts: DataFrame, now_us: int, days: int = 90) -> DataFrame:
    """Alerts that stay: firing, or resolved or last reviewed within ``days``."""
    anchor = F.greatest("resolved_us", F.coalesce("reviewed_us", "resolved_us"))
    return alerts.where((F.col("status") == "firing") | (anchor >= now_us - days * DAY))


#: Names whose values are never shown.
SECRET_NAMES = ("authorization", "password", "secret", "token")
HIDDEN = "[redacted]"
#: White space, by Unicode's list.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _folded(text: Column) -> Column:
    """The text with A-Z in lower case, of the same length."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _around(text: Column, separators: str) -> Column:
    """The text as an array of its separators (one character each) and what stands between them."""
    return F.split(text, f"(?<=[{separators}])|(?=[{separators}])")


def _without_value(item: Column) -> Column:
    """An item ``...name=value`` of a secret name with its value hidden."""
    parts = F.split(item, "=")
    n = F.size(parts)
    named = lambda i: F.exists(F.array(*map(F.lit, SECRET_NAMES)), lambda s: _folded(F.get(parts, i)).endswith(s))
    valued = lambda i: (n - i > 2) | (F.get(parts, i + 1) != "")
    at = F.get(F.filter(F.sequence(F.lit(0), n - 2), lambda i: named(i) & valued(i)), 0)
    hidden = F.concat(F.array_join(F.slice(parts, F.lit(1), at + 1), "="), F.lit(f"={HIDDEN}"))
    return F.when(item.contains("="), F.coalesce(hidden, item)).otherwise(item)


def _without_header(line: Column) -> Column:
    """A line with an authorization header, without what follows it."""
    at = F.instr(_folded(line), "authorization:")
    rest = F.substring(line, at + len("authorization:"), F.length(line))
    blank = F.length(rest) - F.length(F.ltrim(rest, F.lit(" \t\f")))
    hidden = F.concat(F.substring(line, F.lit(1), at + (len("authorization:") - 1) + blank), F.lit(HIDDEN))
    return F.when((at > 0) & (F.length(rest) > blank), hidden).otherwise(line)


def _without_login(part: Column) -> Column:
    """What follows the two slashes of a URL, with its login (up to the sign) hidden."""
    login = F.substring_index(part, "@", 1)
    has = part.contains("@") & (login != "") & ~login.contains("/") & (F.translate(login, " \t\n\f\r", "") == login)
    return F.when(has, F.concat(F.lit(HIDDEN), F.substring(part, F.length(login) + 1, F.length(part)))).otherwise(part)


def redacted(text: Column, limit: int = 4000) -> Column:
    """Details without secrets and outer white space, cut to ``limit`` bytes.

    The text is split at separators, its pieces are judged by name, and it is
    put together again. The value of a secret name ends at the first blank or
    ampersand, an authorization header at the end of its line, a login in a URL
    (what stands between the two slashes and an at sign, with no slash or
    blank) at its sign.
    """
    words = F.array_join(F.transform(_around(F.btrim(text, F.lit(BLANKS)), r" \t\n\f\r&"), _without_value), "")
    lines = F.array_join(F.transform(_around(words, r"\n\r"), _without_header), "")
    urls = F.split(lines, "://")
    return cut_bytes(F.array_join(F.transform(urls, lambda part, i: F.when(i > 0, _without_login(part)).otherwise(part)), "://"), limit)


def cut_bytes(text: Column, limit: int) -> Column:
    """The longest beginning of whole characters within ``limit`` bytes."""
    data = F.encode(text, "UTF-8")
    inner = lambda at: F.substring(F.hex(F.substring(data, at, 1)), 1, 1).isin("8", "9", "A", "B")  # noqa: E731  (a byte within a character)
    end = F.lit(limit - 3)
    for at in (limit - 2, limit - 1, limit):
        end = F.when(~inner(at + 1), at).otherwise(end)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(data, F.lit(1), end).cast("string"))


def quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, prevalence and accuracy of ``predicted`` against ``actual``."""
    c = F.count_if
    p, a = F.col("predicted"), F.col("actual")
    both, n = c(p & a), F.count("*")
    return rows.groupBy(*keys).agg(
        F.try_divide(both, c(p)).alias("precision"), F.try_divide(both, c(a)).alias("recall"), (c(a) / n).alias("prevalence"), (c(p == a) / n).alias("accuracy")
    )
