"""Prefix trie of conversations that share heads, from composable fingerprints.

A sequence of turns has a fingerprint (length, H): H sums t_i * r^i over its
turns, modulo a prime, in four lanes with independent turn hashes t. These
form a monoid, (m, A)(n, B) = (m + n, A + r^m B), and prefixes can be divided
off again. So the fingerprints of a conversation that was rebuilt from another
one's head and its own tail follow from the stored running sums of both, by
one product for each depth; no rebuilt text or sequence is made. Running sums
are taken in blocks of turns and then over the blocks, by the same product.

Equal fingerprints at a depth make a node. Each node is verified: all its
members must refer to the same stored turn (SHA-256 of role and text) and
come from the same node above, which by induction makes the sequences equal;
where that fails, everything is done again with another base r.

A node belongs to its smallest member, and the nodes of one member are a chain
of ending depth. Chains hang on nodes of chains with smaller ids. Sums over
subtrees are sums over chains by pointer doubling, and then running sums along
each chain, so the number of rounds grows with the logarithm of the nesting.

Defined cases: turns are ordered by turn (nulls first), then role and text; a
null role or text is an empty one; repeated rows are turns of their own; a
null conv_id has no rebuilt conversation and is left out; remainders have the
sign of the id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condist.llm.scratch import written

#: Fingerprints are modulo this prime, so that a product fits a long.
PRIME = (1 << 31) - 1
#: Bases to try, one after another, should two sequences share a fingerprint.
BASES = (1_103_515_245, 1_664_525, 1_140_671_485, 22_695_477)
LANES = range(1, 5)
#: Turn numbers of a block, and depths of a block of a chain.
BLOCK = 256
#: Conversation ids that are joined to one text before they are digested.
ENDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def _power(base: int, exponent: Column, bits: int = 40) -> Column:
    """base ** exponent modulo the prime."""
    out = F.lit(1).cast("long")
    for j in range(bits):
        factor = F.when(exponent.bitwiseAND(1 << j) != 0, pow(base, 1 << j, PRIME)).otherwise(1)
        out = out * factor % PRIME
    return out


def _lane(k: int) -> Column:
    """Hash of a turn in lane k, from its reference."""
    h = F.xxhash64(F.lit((k + 1) // 2), "r1", "r2")
    return (F.shiftrightunsigned(h, 32) if k % 2 else h.bitwiseAND(0xFFFFFFFF)) % PRIME


def stored_turns(conversations: DataFrame, base: int) -> DataFrame:
    """Turns without texts: conv_id, block, rank (in the block), reference r1 and r2, words, and running sums l1 to l4 in the block."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).where("conv_id is not null")
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    w = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("r1", half(1)).withColumn("r2", half(17))
    rows = rows.withColumn("words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).withColumn("_w", _power(base, F.col("rank")))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.sum(_lane(k) * F.col("_w") % PRIME).over(upto) % PRIME).alias(f"l{k}") for k in LANES]
    return rows.select("conv_id", "block", "rank", "r1", "r2", "words", *sums)


def blocks(turns: DataFrame, base: int) -> DataFrame:
    """conv_id, block, turns before it, and sums b1 to b4 before it, with what a turn's sum in the block is multiplied by (shift)."""
    own = turns.groupBy("conv_id", "block").agg(F.max("rank").alias("n"), *[F.max_by(f"l{k}", "rank").alias(f"h{k}") for k in LANES])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("shift", _power(base, F.col("before")))
    return rows.select("conv_id", "block", "n", "before", "shift", *[(F.coalesce(F.sum(F.col("shift") * F.col(f"h{k}") % PRIME).over(before), F.lit(0)) % PRIME).alias(f"b{k}") for k in LANES])


def heads(turns: DataFrame, found: DataFrame, longest: int) -> DataFrame:
    """conv_id and head: its first turns (n, r1, r2, words and running sums s1 to s4), at most ``longest``, in order."""
    first = turns.where(F.col("rank") <= longest).join(found.where(F.col("before") < longest), ["conv_id", "block"])
    turn = F.struct((F.col("before") + F.col("rank")).alias("n"), "r1", "r2", "words", *[((F.col(f"b{k}") + F.col("shift") * F.col(f"l{k}")) % PRIME).alias(f"s{k}") for k in LANES])
    return first.where(F.col("before") + F.col("rank") <= longest).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("head"))


def _sum_at(head: str, n: Column, k: int) -> Column:
    """Running sum of the first n turns of a head."""
    return F.when(n > 0, F.get(F.col(head), (n - 1).cast("int"))[f"s{k}"]).otherwise(0).cast("long")


def plans(turns: DataFrame, found: DataFrame, group: int, modulus: int) -> DataFrame:
    """How each conversation is rebuilt: conv_id, h, taken (turns from its base, in ``from``), size (rebuilt), sums f of what is taken and o of its own first h."""
    first = heads(turns, found, modulus - 1)
    convs = found.groupBy("conv_id").agg(F.sum("n").alias("n"))
    own = convs.join(first, "conv_id", "left").withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus)
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    both = own.join(first.select(F.col("conv_id").alias("base"), F.col("head").alias("from")), "base", "left")
    taken = F.least(F.col("h"), F.coalesce(F.size("from"), F.lit(0))).cast("long")
    rows = both.withColumn("taken", taken).withColumn("size", taken + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    skipped = F.least(F.col("h"), F.col("n"))
    return rows.select("conv_id", "h", "taken", "size", "from", *[_sum_at("from", F.col("taken"), k).alias(f"f{k}") for k in LANES], *[_sum_at("head", skipped, k).alias(f"o{k}") for k in LANES])


def _key(sums: list[Column], names: tuple[str, str]) -> list[Column]:
    """Four lanes as two longs."""
    a, b, c, d = sums
    return [(F.shiftleft(a, 31) + b).alias(names[0]), (F.shiftleft(c, 31) + d).alias(names[1])]


def members(turns: DataFrame, found: DataFrame, plan: DataFrame, base: int) -> DataFrame:
    """Each conversation at each depth of its path: conv_id, depth, key (k1, k2), key above (q1, q2), last turn's reference and words, whether it ends there."""
    none = F.lit(0).cast("long")
    above, at = ("q1", "q2"), ("k1", "k2")
    ends = F.col("size") == F.col("depth")
    root = plan.withColumn("depth", none).select("conv_id", "depth", *[none.alias(c) for c in (*at, *above, "r1", "r2", "words")], ends.alias("ends"))
    taken = plan.where("taken > 0").select("conv_id", "size", "from", F.posexplode(F.slice("from", F.lit(1), F.col("taken").cast("int"))).alias("i", "turn"))
    taken = taken.withColumn("depth", F.col("i").cast("long") + 1)
    head = taken.select(
        "conv_id", "depth", *_key([F.col(f"turn.s{k}") for k in LANES], at), *_key([_sum_at("from", F.col("depth") - 1, k) for k in LANES], above), "turn.r1", "turn.r2", "turn.words", ends.alias("ends")
    )
    placed = found.join(plan.drop("from"), "conv_id").where("before + n > h")
    own = turns.join(placed, ["conv_id", "block"]).where("before + rank > h")
    # own sums are divided by r^h, multiplied by r^taken, and put behind what is taken
    back = pow(base, PRIME - 2, PRIME)
    moved = _power(back, F.col("h") - F.col("taken"), 8)
    own = own.withColumn("depth", F.col("taken") + F.col("before") + F.col("rank") - F.col("h")).withColumn("move", moved).withColumn("weight", _power(base, F.col("rank")))
    last = lambda k: F.col(f"l{k}")
    previous = lambda k: (F.col(f"l{k}") + PRIME - _lane(k) * F.col("weight") % PRIME) % PRIME

    def behind(of, k: int) -> Column:
        whole = (F.col(f"b{k}") + F.col("shift") * of(k)) % PRIME
        return (F.col(f"f{k}") + F.col("move") * ((whole + PRIME - F.col(f"o{k}")) % PRIME)) % PRIME

    tail = own.select("conv_id", "depth", *_key([behind(last, k) for k in LANES], at), *_key([behind(previous, k) for k in LANES], above), "r1", "r2", "words", ends.alias("ends"))
    return root.unionByName(head).unionByName(tail)


def grouped(rows: DataFrame) -> DataFrame:
    """Nodes (depth, k1, k2): conv_id (the smallest member), n_convs, words, key above, and whether its members proved equal."""
    same = [(F.min(c) == F.max(c)) for c in ("q1", "q2", "r1", "r2")]
    return rows.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), (same[0] & same[1] & same[2] & same[3]).alias("same")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, of rows sorted by node and part; one text is held at a time."""
    node, digest = None, None
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array([r[0][i] for r in done], pa.int64()) for i in range(3)]
        return pa.record_batch([*columns, pa.array([r[1] for r in done], pa.string())], ["depth", "k1", "k2", "ends_sha256"])

    for batch in batches:
        for *own, text in zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")], strict=True):
            if own != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if done:
            yield flush()
            done = []
    if node is not None:
        done.append((node, digest.hexdigest()))
        yield flush()


def ends(rows: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at a node, for nodes where any does.

    Ids are joined in parts of neighbours in the order of all ids, so a node
    with very many copies is read by one task as a few long texts only.
    """
    last = rows.where("ends").select("conv_id", "depth", "k1", "k2").repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    parts = last.withColumn("part", F.floor(F.monotonically_increasing_id() / ENDS))
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    texts = parts.groupBy("depth", "k1", "k2", "part").agg(ids.alias("ids"))
    return texts.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "part").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """Sums over each chain and all that hang on it, at any remove: chain, leaves, saved; from chain, above (null at the root), leaves, saved.

    Every chain adds what it knows to the chain it points at, and then points
    where that one points: after k rounds sums reach 2^k chains down.
    """
    totals = written(chains.select("chain", "leaves", "saved"), "chain-totals")
    pointers = written(chains.where("above is not null").select("chain", "above"), "chain-pointers")
    while not pointers.isEmpty():
        below = pointers.join(totals, "chain").groupBy("above").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        more = totals.join(below.withColumnRenamed("above", "chain"), "chain", "left")
        far = pointers.select(F.col("chain").alias("above"), F.col("above").alias("_far"))
        jumped = pointers.join(far, "above").select("chain", F.col("_far").alias("above"))
        plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        totals = written(more.select("chain", plus("leaves", "_l"), plus("saved", "_s")), "chain-totals")
        pointers = written(jumped, "chain-pointers")
    return totals


def subtrees(nodes: DataFrame) -> DataFrame:
    """n_leaves and saved of each node's subtree: nodes with conv_id, depth, parent_conv_id, n_children, saved (own)."""
    parts = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.sum("saved").alias("saved"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    hung = nodes.where("parent_conv_id is null or parent_conv_id <> conv_id").select(F.col("conv_id").alias("chain"), F.col("parent_conv_id").alias("above"), (F.col("depth") - 1).alias("at"))
    chains = written(hung.join(parts.withColumnRenamed("conv_id", "chain"), "chain"), "chains")
    totals = chain_totals(chains)
    below = chains.where("above is not null").select("chain", "above", "at").join(totals, "chain").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    rows = nodes.join(below, ["conv_id", "depth"], "left").withColumn("_b", F.floor(F.col("depth") / BLOCK))
    own = {"_l": F.coalesce("_l", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0), "_s": F.coalesce("_s", F.lit(0)) + F.col("saved")}
    rows = written(rows.withColumns(own), "node-values")
    # down the chain: sums in a block of depths from below, and the blocks below
    deeper = Window.partitionBy("conv_id", "_b").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    under = Window.partitionBy("conv_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "_b").agg(F.sum("_l").alias("_l"), F.sum("_s").alias("_s"))
    carried = sums.select("conv_id", "_b", *[F.coalesce(F.sum(c).over(under), F.lit(0)).alias(f"{c}b") for c in ("_l", "_s")])
    run = rows.select(*[c for c in rows.columns if c not in ("_l", "_s")], F.sum("_l").over(deeper).alias("_l"), F.sum("_s").over(deeper).alias("_s"))
    return run.join(carried, ["conv_id", "_b"]).withColumn("n_leaves", F.col("_l") + F.col("_lb")).withColumn("saved_tokens", F.col("_s") + F.col("_sb"))


def trie(conversations: DataFrame, group: int = 20, modulus: int = 4, bases: tuple[int, ...] = BASES) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations.

    Conversation c takes the first h turns of c - c % group, then its own
    after the first h, with h = crc32(c in decimal) % modulus. Columns: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    for base in bases:
        turns = written(stored_turns(conversations, base), "turns")
        found = written(blocks(turns, base), "turn-blocks")
        rows = written(members(turns, found, plans(turns, found, group, modulus), base), "members")
        nodes = written(grouped(rows), "nodes")
        if nodes.where("not same").isEmpty():
            break
    else:
        raise RuntimeError("different sequences share fingerprints under every base")
    at, above = ["depth", "k1", "k2"], [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    # only the first node of a chain has its parent in another one
    first = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"))
    tops = nodes.join(first, ["conv_id", "depth"], "left_semi").where("depth > 0").select(F.col("conv_id").alias("chain"), *above)
    parents = tops.join(nodes.select(*at, F.col("conv_id").alias("parent")), at).select(F.col("chain").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent")
    full = nodes.join(children, at, "left").join(ends(rows), at, "left").join(parents, ["conv_id", "depth"], "left")
    full = full.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    out = subtrees(written(full, "trie-nodes"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_BYTES = "list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))"
_BIT = "xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END)"
_BYTE = "xor(c, b)"
for _ in range(8):
    _BYTE = f"list_reduce([{_BYTE}, 0], lambda s, z: {_BIT})"

OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: {_BYTE}), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS depth, md5(length(role) || ':' || role || text) AS ref, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT c.conv_id, 0 AS part, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.n <= c.h
    UNION ALL SELECT c.conv_id, 1, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h)),
p AS (
  SELECT conv_id, depth, words, string_agg(ref, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
k AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM m GROUP BY path),
f AS (SELECT k.*, q.conv_id AS parent, coalesce(d.n, 0) AS n_children
  FROM k LEFT JOIN k q ON k.depth > 0 AND q.path = left(k.path, length(k.path) - 32)
  LEFT JOIN (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM k WHERE depth > 0 GROUP BY 1) d ON d.path = k.path),
s AS (SELECT left(f.path, CAST(32 * g.d AS BIGINT)) AS path, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.saved) AS saved FROM f, generate_series(0, f.depth) g(d) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path)"""
