import random

import duckdb
import pytest

from condist.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r, x))
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    seqs = {c: tuple((r, x) for t, r, x in sorted(v, key=lambda y: (low(y[0]), text(y[1]), text(y[2])))) for c, v in convs.items()}
    out = []
    for s in set(seqs.values()):
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        ids = [c for c, o in seqs.items() if o == s]
        least = min((c for c in ids if c is not None), default=None)
        out.append((least, len(s), len(ids), "".join(f"<|start|>{r or ''}\n{x or ''}<|end|>\n" for r, x in s)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int").repartition(3)
    parts = {}
    for r in sorted(chat.render(df, **options).collect(), key=lambda r: r.part):
        key = (r.conv_id, r.n_turns, r.copies)
        parts[key] = parts.get(key, "") + r.text
    return sorted(((*k, v) for k, v in parts.items()), key=str)


@pytest.mark.parametrize("block", [256, 2])
def test_snapshots_collapse(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(block)
    rows, conv = [], 0
    for _ in range(25):
        turns = [(3 * i, rng.choice(["user", "bot"]), rng.choice(["a", "b", "c", None])) for i in range(rng.randint(1, 6))]
        for n in rng.choices(range(1, len(turns) + 1), k=rng.randint(1, 5)):
            rows += [(conv, *t) for t in turns[:n]]
            conv += 1
    assert run(spark, rows, part_turns=3) == brute(rows)


def test_edges(spark):
    rows = [(1, 0, None, ""), (2, 0, "", None), (3, None, "user", "x"), (3, 5, "user", "y"), (None, 0, "user", "x"), (4, 0, "user", "x"), (5, 1, "u", "d"), (5, 1, "u", "d"), (6, 0, "user", "long " * 30000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    many = [(9, i, "u", str(i)) for i in range(700)] + [(8, i, "u", str(i)) for i in range(600)]
    assert run(spark, many) == brute(many)


def test_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    names = ["conv_id", "part", "n_turns", "copies", "text"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({chat.OP8_SQL})").fetchall()
    assert sorted(map(tuple, chat.op8_chat(spark, d).select(*names).collect())) == sorted(want)
