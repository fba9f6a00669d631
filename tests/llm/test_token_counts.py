"""Token counts against the library, and what the cache saves."""

import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from condist.llm import token_counts
from condist.llm.scratch import shared_path
from condist.llm.token_counts import Counter, content, count_tokens, default_tokenizer, op12_token_counts

SCHEMA = "doc_id long, text string, content string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def own():
    return Counter(default_tokenizer())


PIECES = ["the", "The", "don't", "it's'", "'s", "''ll", "a-b", "x's!", "...", "?!'", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "|>", "<|", "é", "é", "́", "≠", "ΑΣ", "Σ", "12ab3", "½", "漢字",
          " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "​", "\x00", "😀", "İ", "ﬁ", "가", "_", "http://a.b/c?d=e"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=14).map("".join))
def test_chunks_equal_the_library(library, own, text):
    import pyarrow as pa

    text = text.encode("utf-8", "ignore").decode()
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in (text, "", text + text)]
    assert own.column(pa.array([text, None, text + text])).tolist() == want


def test_documents_equal_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = op12_token_counts(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


def test_only_distinct_misses_are_encoded(spark, monkeypatch):
    """Copies, also in other partitions and in other blanks, are one content; a second run encodes nothing."""
    cache = shared_path(spark, "cache")
    data = [(i, f"some text {i % 3}", "x", 1) for i in range(60)] + [(100, "  some\ttext \n 1 ", "x", 1), (None, None, None, None), (101, "", "x", 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    first = {(r.doc_id, r.n_bytes): r.n_tokens for r in count_tokens(df, cache).collect()}
    assert len(first) == 63 and first[100, 16] == 3 and first[None, 0] == 0 and first[101, 0] == 0
    stored = spark.read.parquet(cache)
    assert stored.count() == 4  # three texts and the empty one
    again = {(r.doc_id, r.n_bytes): r.n_tokens for r in count_tokens(df, cache).collect()}
    assert again == first and spark.read.parquet(cache).count() == 4
    more = spark.createDataFrame([(1, "some text 0", "x", 1), (2, "a new one", "x", 1)], SCHEMA)
    assert [r.n_tokens for r in count_tokens(more, cache).orderBy("doc_id").collect()] == [3, 3]
    assert spark.read.parquet(cache).count() == 5


def test_appends_that_repeat_count_once(spark):
    cache = shared_path(spark, "cache")
    df = spark.createDataFrame([(1, "one two", "x", 1), (1, "one two", "x", 1)], SCHEMA)
    count_tokens(df, cache).collect()
    spark.read.schema(token_counts.CACHE).parquet(cache).write.mode("append").partitionBy("version").parquet(cache)
    assert [(r.doc_id, r.n_tokens) for r in count_tokens(df, cache).collect()] == [(1, 2), (1, 2)]


def test_another_tokenizer_has_its_own_counts(spark, tmp_path):
    other = tmp_path / f"{uuid.uuid4().hex}.json"
    other.write_text(open(default_tokenizer()).read() + "\n")
    cache = shared_path(spark, "cache")
    df = spark.createDataFrame([(1, "one two", "x", 1)], SCHEMA)
    count_tokens(df, cache).collect()
    count_tokens(df, cache, str(other)).collect()
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def test_long_empty_and_missing(spark, library):
    draw = random.Random(3)
    long = " ".join("".join(draw.choices("abcdefgh'-.,É", k=draw.randint(1, 9))) for _ in range(200_000))
    solid = "ab1" * 100_000
    df = spark.createDataFrame([(1, long, "x", 1), (2, solid, "x", 1), (3, "   ", "x", 1)], SCHEMA)
    out = {r.doc_id: r for r in count_tokens(df, shared_path(spark, "cache")).collect()}
    for i, text in ((1, long), (2, solid), (3, "   ")):
        assert out[i].n_tokens == len(library.encode(text, add_special_tokens=False).ids)
    assert out[1].over_limit and not out[3].over_limit
    assert count_tokens(df.limit(0), shared_path(spark, "cache")).collect() == []


def test_content_folds_blanks_only(spark):
    df = spark.createDataFrame([(0, "a  b"), (0, " a b\n"), (0, "a b"), (0, "A b"), (0, "ab")], "doc_id long, text string")
    assert df.select(content(df.text).alias("c")).distinct().count() == 4
