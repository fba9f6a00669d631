"""Queries of the stored chunk table: events as writes of their window's chunk, in two rounds with verdicts between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.functions.shared import shared_folder
from condist.operators import store
from condist.plans import views as v
from condist.plans.registry import VIEWS, query

E = SparkSession
#: A write's round, and its generation: events of the second round may bring a newer one.
ROUND = "event_id % 5 < 3"
GENERATION = "event_id % 7 div 3"


def writes(spark: E, d: str) -> DataFrame:
    return v.win(spark, d).select("service", "w", F.expr(GENERATION).alias("generation"), F.col("us").alias("collected_at"), F.col("event_id").alias("id"), F.col("value").alias("body"))


def filled(spark: E, d: str) -> str:
    """The table after a round of writes, their verdicts, and another round."""
    path, rows = shared_folder(spark, "chunk-store"), writes(spark, d)
    first = F.expr(ROUND.replace("event_id", "id"))
    store.write_chunks(spark, path, rows.where(first), v.KEY)
    found = rows.where(first & F.expr("id % 2 = 0")).select(
        *v.KEY, "generation", F.when(F.expr("id % 3 = 0"), "bad").otherwise("good").alias("state"), (1 / (1 + F.col("id"))).alias("p"), (F.col("id") * 10).alias("analysed_at")
    )
    store.write_verdicts(spark, path, store.table(spark, path), found, v.KEY)
    store.write_chunks(spark, path, rows.where(~first), v.KEY)
    return path


VIEWS["store_writes"] = f"SELECT service, w, {GENERATION.replace('div', '//')} AS generation, us AS collected_at, event_id AS id, value AS body, {ROUND} AS early FROM win"
_LAST = "row_number() OVER (PARTITION BY service, w ORDER BY generation DESC, collected_at DESC, id DESC) AS k"
VIEWS["store_first"] = f"SELECT * FROM (SELECT *, {_LAST} FROM store_writes WHERE early) WHERE k = 1"
VIEWS["store_verdicts"] = """
SELECT f.service, f.w, f.generation, arg_max(CASE WHEN x.id % 3 = 0 THEN 'bad' ELSE 'good' END, x.id) AS state, arg_max(1 / (1 + x.id), x.id) AS p
FROM store_first f JOIN store_writes x ON x.service = f.service AND x.w = f.w AND x.generation = f.generation AND x.early AND x.id % 2 = 0 GROUP BY ALL"""
VIEWS["store_rows"] = f"""
SELECT c.service, c.w, c.generation, c.collected_at, c.id, c.body, coalesce(s.state, 'pending') AS state, s.p
FROM (SELECT * FROM (SELECT *, {_LAST} FROM store_writes) WHERE k = 1) c LEFT JOIN store_verdicts s ON s.service = c.service AND s.w = c.w AND s.generation = c.generation"""
COLUMNS = ["service", "w", "generation", "collected_at", "id", "body", "state"]


@query(f"SELECT {', '.join(COLUMNS)}, round(p, 9) AS p FROM store_rows")
def chunk_store(spark: E, d: str) -> DataFrame:
    """The stored chunks with their verdicts after all rounds."""
    return store.table(spark, filled(spark, d)).select(*COLUMNS, F.round("p", 9).alias("p"))


@query("SELECT service, w, generation, body, state FROM store_rows WHERE (w // 21600000000) % 10 = 0")
def chunk_point_read(spark: E, d: str) -> DataFrame:
    """The chunks of every tenth window, each by its key."""
    wanted = writes(spark, d).where(f"w div {v.WINDOW} % 10 = 0").select(*v.KEY)
    return store.read_chunks(spark, filled(spark, d), wanted, v.KEY).select(*v.KEY, "generation", "body", "state")
