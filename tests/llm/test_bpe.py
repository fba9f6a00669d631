import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from condist.llm import bpe
from condist.llm.tokens import default_tokenizer, encoder

PARTS = ["'", "s", "re", "ve", "ll", "t", "d", "m", " ", "  ", "\n", "\r\n", "\t", " ", "　", "a", "B", "é", "ß", "1", "²", "½", "٣", "-", "!", "...", "’", "\U0001f600", "é", "<|endoftext|>", "中文", "\x1c", "\x85", "​", "'S", "'ll", "'re", "\x00"]


def row(text):
    tk = encoder(default_tokenizer()).tokenizer
    ids = tk.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tk.decode(ids, skip_special_tokens=False).encode())


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_columns_encode_as_the_library_does(texts):
    enc = encoder(default_tokenizer())
    ids, bounds = enc.column(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op7_bpe(spark, d).collect()} == {i: row(t) for i, t in texts.items()}


def test_edges_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1)
    texts = [None, "", "tie", "tie", "a <|endoftext|><|endoftext|> b", "word " * 30000, "é" * 300] + ["x%d y" % i for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "tie", 2)], "doc_id long, text string, block int").repartition(3)
    got = bpe.encode_decode(docs, shards=5, with_ids=True).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:4]) for r in got) == sorted((str(i), *row(t)) for i, t in [*enumerate(texts), (None, "tie")])
    assert all(r.decoded == (texts[r.doc_id] or "") for r in got if r.doc_id is not None)
    assert bpe.encode_decode(docs.limit(0)).collect() == []


def test_each_distinct_word_is_encoded_once(monkeypatch):
    enc, calls = encoder(default_tokenizer()), []
    word = enc.word
    monkeypatch.setattr(enc, "word", lambda w: calls.append(w) or word(w))
    lists = [(1, 0, [b"a", b" tie", b"x1"]), (2, 0, [b" tie", b"b"]), (1, 1, [b" on"]), (2, 1, [b" on", b" off"])]
    batch = pa.record_batch([pa.array([x[0] for x in lists]), pa.array([x[1] for x in lists]), pa.array([bpe.packed_words(x[2]) for x in lists], pa.binary())], ["block", "shard", "words"])
    out = list(bpe.encoded(iter([batch.slice(0, 3), batch.slice(3)]), default_tokenizer()))
    assert sorted(calls) == sorted({w for _, _, words in lists for w in words}) and len(out) == 4
    ids = bpe.unpacked(out[1].column("ids")[0].as_py()).tolist()
    assert ids == enc.tokenizer.encode(" tieb", add_special_tokens=False).ids or len(ids) == sum(bpe.unpacked(out[1].column("sizes")[0].as_py()))
