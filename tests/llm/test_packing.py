import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from condist.llm import packing
from condist.llm.tokens import default_tokenizer, encoder


def brute_sums(counts, gap):
    sums = {0}
    for n, k in counts.items():
        sums = {s + n * i for s in sums for i in range(k + 1) if s + n * i <= gap}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 90))
def test_best_fill_is_the_optimum(counts, gap):
    available = sum(1 << n for n in counts)
    best, used = packing.best_fill(counts, available, gap)
    assert best == brute_sums(counts, gap) == sum(n * k for n, k in used.items())
    assert all(k <= counts[n] for n, k in used.items())


def check(rows, texts, capacity=2048):
    enc = encoder(default_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        want = [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            own = np.array(want[r.start : r.start + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(own.tobytes()))
            at += r.length
        assert at == len(want)
    used = padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and all(r.sequence_tokens == at for r in own)
        used += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, used


def test_documents_are_packed_whole_with_little_padding(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    padding, used = check(packing.op1_packing(spark, d).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert padding <= 0.01 * used


@pytest.mark.parametrize("parts", [1, 3])
def test_edges(spark, parts):
    texts = {1: None, 2: "", 3: "x" * 9000, 4: "word " * 30000, 5: "tie", 6: "tie", 7: "<|endoftext|> a"}
    docs = spark.createDataFrame([(k, v, 9) for k, v in texts.items()], "doc_id long, text string, start int").repartition(parts)
    check(packing.digest(packing.pack(docs)).collect(), texts)


def test_hot_length_is_cut_rather_than_padded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the " * 900).alias("text")).coalesce(2)
    padding, used = check(packing.digest(packing.pack(docs)).collect(), {i: "the " * 900 for i in range(3000)})
    assert padding <= 0.003 * used


def test_empty_and_null_ids(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert [r.doc_tokens for r in rows] == [2, 2]
