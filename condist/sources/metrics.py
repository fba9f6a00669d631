"""Metric store exports: range-matrix responses, native histograms, and checks of what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.operators.samples import usable

#: A range query's response; values are (seconds, number as text).
RESPONSE = (
    "struct<status string, data struct<resultType string, result array<struct<"
    "metric map<string,string>, values array<array<string>>, histograms array<array<string>>>>>>"
)
#: A histogram of a response, which stands there behind its time; buckets are (kind, lower, upper, count as text).
HISTOGRAM = "struct<count string, sum string, buckets array<array<string>>>"
#: An exported query with its response.
EXPORT = f"query string, start string, end string, step_seconds long, status_code int, response_body {RESPONSE}"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response files (one JSON document each) as column ``response``."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.from_json("value", RESPONSE).alias("response"))


def exports(spark: SparkSession, path: str, partitions: str = "", stream: bool = False) -> DataFrame:
    """Exported responses, one JSON document a line, in folders by ``partitions`` (column and type): partition columns, start_us, end_us, response, problem.

    A document that cannot be used has a ``problem`` and stops nothing: it is
    no JSON, its query or response failed, or it is not one series of a matrix.
    """
    schema = f"{EXPORT}, _corrupt string" + (f", {partitions}" if partitions else "")
    reader = (spark.readStream if stream else spark.read).schema(schema).option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.json(path)
    body = F.col("response_body")
    series = F.coalesce(F.size(body["data"]["result"]), F.lit(0))
    kind = F.coalesce(body["data"]["resultType"], F.lit("nothing"))
    problem = (
        F.when(F.col("_corrupt").isNotNull(), "not JSON")
        .when(F.col("status_code") != 200, F.concat(F.lit("status "), F.col("status_code").cast("string")))
        .when(~body["status"].eqNullSafe("success"), "query failed")
        .when(kind != "matrix", F.concat(F.lit("expected a matrix, got "), kind))
        .when(series == 0, "no data")
        .when(series > 1, "several series")
    )
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X")))
    kept = [p.split()[0] for p in partitions.split(",") if p]
    return rows.select(*kept, micros("start").alias("start_us"), micros("end").alias("end_us"), body.alias("response"), problem.alias("problem"))


def histogram_points(responses: DataFrame) -> DataFrame:
    """Buckets of the histograms of matrix responses: the other columns, series, ts_s, upper, count."""
    kept = [c for c in responses.columns if c != "response"]
    series = responses.select(*kept, F.posexplode("response.data.result").alias("series", "r"))
    points = series.select(*kept, "series", F.explode("r.histograms").alias("h"))
    buckets = points.select(*kept, "series", F.col("h")[0].cast("double").alias("ts_s"), F.explode(F.from_json(F.col("h")[1], HISTOGRAM)["buckets"]).alias("b"))
    bound = F.replace(F.col("b")[2], F.lit("+Inf"), F.lit("Infinity"))
    return histogram_buckets(buckets.select(*kept, "series", "ts_s", bound.alias("upper"), F.col("b")[3].alias("count")))


def range_matrix(responses: DataFrame) -> DataFrame:
    """Points of range-matrix responses: the other columns, series (number in its response), ts_s, value.

    A response of another type raises.
    """
    kept = [c for c in responses.columns if c != "response"]
    kind = F.col("response.data.resultType")
    checked = F.when(kind == "matrix", F.col("response.data.result")).otherwise(
        F.raise_error(F.concat(F.lit("expected a matrix, got "), F.coalesce(kind, F.lit("nothing"))))
    )
    series = responses.select(*kept, F.posexplode(checked).alias("series", "r"))
    points = series.select(*kept, "series", F.explode("r.values").alias("p"))
    return points.select(*kept, "series", F.col("p")[0].cast("double").alias("ts_s"), F.col("p")[1].cast("double").alias("value"))


def after_start(points: DataFrame, start: str = "start_s", end: str = "end_s", at: str = "ts_s") -> DataFrame:
    """Points of (start, end]: one exactly at the start belongs to the window before."""
    return points.where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end)))


def histogram_buckets(rows: DataFrame, upper: str = "upper", count: str = "count") -> DataFrame:
    """Bucket texts as numbers: upper bound, and count rounded half away from zero; an unusable bound raises."""
    bound = F.col(upper).cast("double")
    bad = F.isnan(bound) | (bound == float("-inf")) | bound.isNull()
    checked = F.when(bad, F.raise_error(F.lit("histogram bound is not a number"))).otherwise(bound)
    return rows.withColumn("upper", checked).withColumn("count", F.round(F.col(count).cast("double")).cast("long"))


def series_check(points: DataFrame, keys: list[str], series: str) -> DataFrame:
    """Number of series of each window and its status: ok, no data, or more than one series."""
    out = points.groupBy(*keys).agg(F.count_distinct(series).alias("series"))
    status = F.when(F.col("series") == 0, "no data").when(F.col("series") == 1, "ok").otherwise("several series")
    return out.withColumn("status", status)


def finite_check(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Samples of each window, how many are not finite, and whether the window is valid."""
    out = points.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(~usable(value)).alias("invalid"))
    return out.withColumn("valid", F.col("invalid") == 0)


def probe(points: DataFrame, service: str, end_us: int, minutes: int = 5) -> DataFrame:
    """What the last whole minutes hold by service: valid, samples, latest; latest is the largest value, as samples are ordered by value."""
    start = end_us - minutes * 60_000_000
    part = points.where((F.col("us") > start) & (F.col("us") <= end_us))
    out = part.groupBy(service).agg(F.count("*").alias("samples"), F.max("value").alias("latest"), F.bool_and(usable("value")).alias("valid"))
    return out
