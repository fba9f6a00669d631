"""Token counts through a digest cache.

The cache is a table of (version, content, n_tokens): ``version`` is the
SHA-256 of the tokenizer's file, ``content`` that of the normalised text.
Runs of blanks (space, tab to carriage return) count as one and outer ones
not at all, which this kind of tokenizer drops; nothing else is folded.
Documents join the cache by digest; of what it lacks, each distinct content
is encoded once, wherever its copies are, and appended.

Only texts that are not in the cache yet travel, compressed and once for each
task that holds a copy, so a text that fills a third of the table is not one
task's work. An append that is repeated after a failure leaves equal rows,
which count as one.

A text is counted by its chunks: cuts at blanks, and where an ASCII letter or
digit meets other ASCII marks (not an apostrophe), never change the tokens.
Chunks of a batch are dictionary encoded, so a worker encodes a chunk that it
remembers only once.

Defined cases: a null text counts as empty; special tokens' strings in a text
are their tokens, as the library does; texts may be of any length; null
doc_ids and repeated rows are returned each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.llm.scratch import shared_path, written
from condist.llm.tokens import byte_strings, flat, slices

LIMIT = 2048
#: Chunks that a worker remembers, in each of two generations.
CACHE_CHUNKS = 200_000
KEPT_CHUNKS = 50_000
#: Digests that a task remembers in order to send a text once.
SEEN = 1_000_000
CACHE = "content binary, n_tokens long, version string"
BLANK, WORD, MARK, OTHER = range(4)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def version(path: str) -> str:
    """SHA-256 of the tokenizer's file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def content(text: Column) -> Column:
    """Digest of the normalised text."""
    return F.unhex(F.sha2(F.btrim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "), F.lit(" ")).cast("binary"), 256))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each byte: blank, ASCII letter or digit, other ASCII mark, or neither (apostrophe, controls, other than ASCII)."""
    table = np.full(256, OTHER, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = BLANK
    for b in range(33, 127):
        table[b] = WORD if chr(b).isalnum() else MARK
    table[ord("'")] = OTHER
    return table


class Counter:
    """Counts tokens of columns with one tokenizer file, remembering chunks it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def chunk(self, chunk: bytes) -> int:
        if chunk.isalpha() and chunk.isascii():
            return len(self.tokenizer.model.tokenize(chunk.lower().decode()))
        return len(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids)

    def chunks(self, chunks: list[bytes]) -> np.ndarray:
        """Tokens of each chunk; those met lately are remembered."""
        if len(self.known) > CACHE_CHUNKS:
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, np.empty(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            n = known.get(c)
            if n is None:
                n = older.get(c)
                known[c] = n = self.chunk(c) if n is None else n
            out[i] = n
        return out

    def rest(self) -> None:
        self.known, self.older = dict(islice((self.older or self.known).items(), KEPT_CHUNKS)), {}

    def column(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = np.zeros(len(texts), bool)
        for token in self.special:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        body, offsets = flat(texts)
        if not len(body):
            return np.zeros(len(texts), np.int64)
        kind = _kinds()[body]
        full = kind != BLANK
        before = np.concatenate(([BLANK], kind[:-1]))
        start = full & (before == BLANK)
        plain = (((before == WORD) & (kind == MARK)) | ((before == MARK) & (kind == WORD))) & np.repeat(~marked, np.diff(offsets))
        start |= plain
        start[offsets[:-1][np.diff(offsets) > 0]] = True  # of its text
        start &= full
        places = np.concatenate(([0], np.cumsum(full)))
        starts = places[:-1][start]
        edges = pa.py_buffer(np.append(starts, places[-1]).astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(starts), edges, pa.py_buffer(body[full].tobytes())).dictionary_encode()
        counts = self.chunks(byte_strings(coded.dictionary))[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(ends[np.searchsorted(starts, places[offsets])])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, size, body): each text once a task, compressed."""
    seen: set[bytes] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            keys = part.column("content").to_pylist()
            fresh = []
            for i, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if len(seen) > SEEN:
                seen.clear()
            raw = byte_strings(part.column("text").take(pa.array(fresh, pa.int64())))
            bodies = [pa.compress(b, "zstd", asbytes=True) for b in raw]
            yield pa.record_batch([pa.array([keys[i] for i in fresh], pa.binary()), pa.array([len(b) for b in raw], pa.int64()), pa.array(bodies, pa.binary())], ["content", "size", "body"])


def _counted(batches: Iterator[pa.RecordBatch], path: str, slice_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """(content, n_tokens) of rows sorted by content; equal neighbours are counted once."""
    own, last = counter(path), None
    for batch in batches:
        keys, sizes, bodies = batch.column("content").to_pylist(), batch.column("size").to_pylist(), batch.column("body")
        held: list[int] = []
        texts: list[bytes] = []
        total = 0
        for i in range(batch.num_rows + 1):
            if total >= slice_bytes or (i == batch.num_rows and held):
                found = own.column(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
                yield pa.record_batch([pa.array([keys[h] for h in held], pa.binary()), pa.array(found, pa.int64())], ["content", "n_tokens"])
                held, texts, total = [], [], 0
            if i < batch.num_rows and keys[i] != last:
                last = keys[i]
                held.append(i)
                texts.append(pa.decompress(bodies[i].as_py(), sizes[i], "zstd", asbytes=True) if sizes[i] else b"")
                total += sizes[i]
    own.rest()


def stored(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """What the cache holds for a version: content, n_tokens."""
    rows = spark.read.schema(CACHE).parquet(cache)
    return rows.where(F.col("version") == of).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def missing(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Texts (content, size, body) that the cache lacks; copies from different tasks are neighbours in one partition."""
    sent = docs.mapInArrow(_sent, "content binary, size long, body binary")
    return sent.repartition("content").join(known, "content", "left_anti").sortWithinPartitions("content")


def count_tokens(docs: DataFrame, cache: str, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document; counts that the cache at path ``cache`` lacks are added to it first."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    of = version(path)
    spark.createDataFrame([], CACHE).write.mode("ignore").partitionBy("version").parquet(cache)  # a new cache is an empty table
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("content", content(F.col("text")))
    fresh = missing(rows.select("content", "text"), stored(spark, cache, of)).mapInArrow(lambda b: _counted(b, path), "content binary, n_tokens long")
    fresh.withColumn("version", F.lit(of)).write.mode("append").partitionBy("version").parquet(cache)
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    # as a table, so that Spark can split the rows of a content that very many documents share
    found = sizes.join(written(stored(spark, cache, of), "counts"), "content", "left")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through a cache that begins empty."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_path(spark, "token-counts"))
