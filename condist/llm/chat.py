"""Chat formatting after collapse of cumulative snapshots.

Loggers often store a conversation again after each turn. A turn's hash covers
its position, so the sums of hashes up to a turn identify the prefix that ends
there, and sums over blocks of turns add up: no conversation is gathered in
one task to compute them. Conversations with equal whole keys count as one
(least conv_id), an anti-join with the keys of proper prefixes keeps the
maximal ones, and only those are rendered, in parts of bounded length.

Defined cases: turns are ordered by turn (nulls first), then role and text; a
null role or text differs from an empty one in the key and is rendered empty;
repeated rows are turns of their own; a null conv_id is a conversation;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condist.llm.scratch import written

#: Turn numbers of one block, and so turns of one rendered part (unless turn numbers repeat).
BLOCK = 256
KEY = ("n", "k1", "k2", "k3", "k4")


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with block (of turn numbers), and n: their position in the conversation, from 1."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    return _after_blocks(rows.withColumn("rank", F.row_number().over(inside)), rows.groupBy("conv_id", "block").agg(F.count("*").alias("turns")), {"turns": "rank"}, {"rank": "n"})


def _after_blocks(rows: DataFrame, totals: DataFrame, sums: dict[str, str], names: dict[str, str]) -> DataFrame:
    """Sums within blocks carried on over a conversation's blocks: column ``sums[c]`` plus the earlier blocks' c, as ``names``."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in sums])
    r, c = rows.alias("r"), carried.alias("c")
    joined = r.join(c, F.col("r.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("r.block") == F.col("c.block")))
    own = [F.col(f"r.{x}") for x in rows.columns if x not in sums.values()]
    return joined.select(*own, *[(F.col(f"r.{s}") + F.col(f"c.before_{c}")).alias(names[s]) for c, s in sums.items()])


def _halves(salt: int) -> list[Column]:
    h = F.xxhash64(F.lit(salt), "n", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF)]


def prefix_keys(turns: DataFrame) -> DataFrame:
    """conv_id and n (position) with k1 to k4: sums of the hash halves of the first n turns."""
    parts = [*_halves(1), *_halves(2)]
    rows = turns.select("conv_id", "block", "n", *[p.alias(f"h{i}") for i, p in enumerate(parts, 1)])
    inside = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("conv_id", "block", "n", *[F.sum(f"h{i}").over(inside).alias(f"s{i}") for i in range(1, 5)])
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(f"h{i}").alias(f"t{i}") for i in range(1, 5)])
    return _after_blocks(run, totals, {f"t{i}": f"s{i}" for i in range(1, 5)}, {f"s{i}": f"k{i}" for i in range(1, 5)})


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that no longer one begins with: conv_id (the least of equal ones), n, copies."""
    keys = written(prefix_keys(turns), "prefix-keys")
    sizes = turns.groupBy("conv_id").agg(F.max("n").alias("all"))
    k, s = keys.alias("k"), sizes.alias("s")
    marked = k.join(s, F.col("k.conv_id").eqNullSafe(F.col("s.conv_id"))).select("k.conv_id", *[f"k.{x}" for x in KEY], "s.all")
    whole = marked.where(F.col("n") == F.col("all")).groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = marked.where(F.col("n") < F.col("all")).select(*KEY).distinct()
    return whole.join(proper, list(KEY), "left_anti").select("conv_id", "n", "copies")


def template(role: Column, text: Column) -> Column:
    """One turn in a plain marked-up form."""
    return F.concat(F.lit("<|start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def render(conversations: DataFrame, part_turns: int = BLOCK) -> DataFrame:
    """Maximal conversations as text: conv_id, part, n_turns, copies, text; parts in order make up the whole."""
    turns = written(numbered(conversations), "turns")
    kept = maximal(turns).alias("m")
    t = turns.alias("t")
    rows = t.join(kept, F.col("t.conv_id").eqNullSafe(F.col("m.conv_id"))).select("t.conv_id", F.col("m.n").alias("n_turns"), "m.copies", "t.n", template(F.col("t.role"), F.col("t.text")).alias("line"))
    part = F.floor((F.col("n") - 1) / part_turns)
    lists = rows.groupBy("conv_id", "n_turns", "copies", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return lists.select("conv_id", "part", "n_turns", "copies", F.concat_ws("", "lines.line").alias("text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations),
p AS (
  SELECT conv_id, n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    md5(string_agg(coalesce(length(role)::VARCHAR, '-') || ':' || coalesce(role, '') || coalesce(length(text)::VARCHAR, '-') || ':' || coalesce(text, ''), '')
      OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k
  FROM t),
w AS (SELECT n AS n_turns, k, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE n = n_turns GROUP BY n, k),
m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = w.n_turns AND p.k = w.k AND p.n < p.n_turns))
SELECT m.conv_id, CAST((t.n - 1) // 256 AS BIGINT) AS part, CAST(m.n_turns AS BIGINT) AS n_turns, CAST(m.copies AS BIGINT) AS copies,
  string_agg('<|start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10), '' ORDER BY t.n) AS text
FROM m JOIN t ON t.conv_id = m.conv_id
GROUP BY m.conv_id, (t.n - 1) // 256, m.n_turns, m.copies"""
