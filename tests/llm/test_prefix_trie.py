"""The trie against plain Python over rebuilt sequences."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from condist.llm import prefix_trie
from condist.llm.prefix_trie import OP11_SQL, op11_prefix_trie, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, group=20, modulus=4):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % modulus
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    parents = {p: min(c for c, _ in m) for p, m in nodes.items()}
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p, m in nodes.items():
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    digest = lambda m: hashlib.sha256(",".join(str(c) for c, last in sorted(m) if last).encode()).hexdigest()
    return sorted(((parents[p], len(p), parents[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], digest(m)) for p, m in nodes.items()), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(parts)


def conversations(seed, n=90, longest=9, alphabet=2, step=1):
    """Conversations of few different turns, so that many share heads or are equal."""
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(draw.randint(1, longest)):
            rows.append((c * step - 30, turn, draw.choice(["user", "assistant"][: draw.randint(1, 2)]), " ".join(["hi"] * draw.randint(1, alphabet))))
    draw.shuffle(rows)
    return rows


def test_equals_plain_code(spark):
    rows = conversations(1)
    assert got(trie(frame(spark, rows))) == plain(rows)


def test_blocks_and_parts(spark, monkeypatch):
    """Blocks of two turns and two ids a part give the same nodes; so do absent bases and shorter ones."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "ENDS", 2)
    rows = conversations(5, 70, 12, step=3)
    assert got(trie(frame(spark, rows))) == plain(rows)
    rows = [(20, 0, "u", "a"), *[(c, t, "u", f"w {t}") for c in (21, 22, 23, 24, 25) for t in range(3)], *[(c, 0, "u", "only") for c in range(61, 80)]]
    assert got(trie(frame(spark, rows))) == plain(rows)


def test_defined_cases(spark):
    rows = [
        (None, 0, "u", "left out"),
        (5, None, None, None),
        (5, None, "a", "second by role"),
        (5, 1, "u", ""),
        (5, 1, "u", ""),
        (6, None, "", ""),
        (6, 3, "u", "x\ty z  w"),
        (-7, 0, "u", "one"),
        (-7, 1, "v", "two"),
        (-20, 5, "u", "one"),
        (40, 0, "u", "é" * 3),
    ]
    assert got(trie(frame(spark, rows))) == plain(rows)
    assert trie(frame(spark, rows).limit(0)).collect() == []
    assert trie(frame(spark, rows[:1])).collect() == []


def test_one_long_conversation_and_many_copies(spark):
    rows = [(0, t, "u", f"turn {t % 5}") for t in range(700)]
    rows += [(c, t, "u", f"turn {t % 5}") for c in range(100, 160) for t in range(3)]
    assert got(trie(frame(spark, rows))) == plain(rows)


def test_colliding_fingerprints_are_found(spark, monkeypatch):
    """A base of zero loses all but lengths; verification turns it down and the next base is taken."""
    rows = conversations(3, 30)
    assert got(trie(frame(spark, rows), bases=(0, prefix_trie.BASES[0]))) == plain(rows)
    with pytest.raises(RuntimeError):
        trie(frame(spark, rows), bases=(0,))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({OP11_SQL})").fetchall()
    assert got(op11_prefix_trie(spark, sf)) == sorted(want, key=str) and len(want) > 30
