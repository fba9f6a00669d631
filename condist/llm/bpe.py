"""BPE encoding and decoding through a table of distinct words.

Documents are cut into words in blocks of bounded size. A block keeps its
documents as codes into its own distinct words (frequent words have small
codes, which compress well), and the words go out by a hash of the word: equal
words of all blocks meet in one shard of the distinct-word table, where each
is encoded once, and the ids go back to the blocks. There the codes are looked
up in the ids by position, and the ids in the vocabulary's pieces for decoding.
Blocks are written to buckets, so only words by block and their ids are
shuffled, in compressed lists, not the documents. A task holds one shard of
the table at a time; more shards make them smaller.

Defined cases: a null text counts as empty and has no ids; special tokens'
strings in a text become their ids, as the tokenizers library does; null
doc_ids are kept; repeated rows are returned each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.llm.scratch import bucketed
from condist.llm.tokens import byte_strings, default_tokenizer, encoder, gather, slices

#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: Words whose ids are joined and decoded at once.
DECODE_WORDS = 1 << 19
BLOCKS = "block long, doc_id array<long>, n_words array<long>, codes binary, places binary, shards array<binary>"
ENCODED = "block long, shard int, sizes binary, ids binary"


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed_words(raw: list[bytes]) -> bytes:
    """Words as their lengths in bytes and the bytes, compressed."""
    body = len(raw).to_bytes(8, "little") + np.fromiter(map(len, raw), "<u4", len(raw)).tobytes() + b"".join(raw)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(body[:8], "little")
    ends = np.cumsum(np.frombuffer(body, "<u4", n, 8)) + 8 + 4 * n
    return [body[a:b] for a, b in zip([8 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def blocks(docs: DataFrame, path: str, shards: int) -> DataFrame:
    """Blocks of documents as codes into distinct words by falling frequency, and those words by shard.

    ``places`` says at which place of the shards' words, end to end, the word of a code is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        words: list[pa.Array] = []
        counts: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal number, held
            coded = pa.chunked_array(words).unify_dictionaries()
            known = byte_strings(coded.chunk(0).dictionary)
            found = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
            shard = np.fromiter((zlib.crc32(w) % shards for w in known), np.int64, len(known))
            by_shard = np.argsort(shard, kind="stable")
            by_count = np.argsort(-np.bincount(found, minlength=len(known)), kind="stable")
            code, place = np.empty(len(known), np.int64), np.empty(len(known), np.int64)
            code[by_count] = np.arange(len(known))
            place[by_shard] = np.arange(len(known))
            bounds = np.searchsorted(shard[by_shard], np.arange(shards + 1))
            lists = [packed_words([known[i] for i in by_shard[a:b]]) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
            row = pa.record_batch(
                [
                    pa.array([base + number]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([np.concatenate(counts)], pa.list_(pa.int64())),
                    pa.array([packed(code[found])], pa.binary()),
                    pa.array([packed(place[by_count])], pa.binary()),
                    pa.array([lists], pa.list_(pa.binary())),
                ],
                ["block", "doc_id", "n_words", "codes", "places", "shards"],
            )
            number, held = number + 1, 0
            ids.clear(), words.clear(), counts.clear()
            return row

        for batch in batches:
            for part in slices(batch, "text"):
                coded, bounds = encoder(path).cut(part.column("text"))
                ids += part.column("doc_id").to_pylist()
                words.append(coded)
                counts.append(np.diff(bounds))
                held += part.column("text").nbytes
                if held >= BLOCK_BYTES:
                    yield block()
        if ids:
            yield block()

    return docs.mapInArrow(run, BLOCKS)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Lists of ids for lists of words (block, shard, words), rows of one shard together; each distinct word is encoded once."""
    shard, table, encode = None, {}, encoder(path).word
    for batch in batches:
        for i in range(batch.num_rows):
            if (own := batch.column("shard")[i].as_py()) != shard:
                shard, table = own, {}
            words = unpacked_words(batch.column("words")[i].as_py())
            table |= {w: encode(w) for w in words if w not in table}
            lists = [table[w] for w in words]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
            row = [batch.column("block").slice(i, 1), batch.column("shard").slice(i, 1), [packed(sizes)], [packed(np.frombuffer(b"".join(lists), "<u4"))]]
            yield pa.record_batch([*row[:2], *(pa.array(x, pa.binary()) for x in row[2:])], ["block", "shard", "sizes", "ids"])


def encode_words(table: DataFrame, path: str) -> DataFrame:
    """Ids of each block's words, shard by shard of the distinct-word table."""
    by_shard = table.select("block", F.posexplode("shards").alias("shard", "words")).where("words is not null")
    return by_shard.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda batches: encoded(batches, path), ENCODED)


def joined(table: DataFrame, encoded: DataFrame) -> DataFrame:
    """Blocks with the ids of their words in the order of the codes."""
    lists = encoded.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "sizes", "ids"))).alias("words"))
    return table.drop("shards").join(lists, "block", "left").select(
        "doc_id",
        "n_words",
        "codes",
        "places",
        F.coalesce("words.sizes", F.array()).alias("sizes"),
        F.coalesce("words.ids", F.array()).alias("ids"),
    )


def documents(rows: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded text; with the ids and the text if asked for."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if with_ids else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                doc_ids, counts = row["doc_id"].as_py(), row["n_words"].values.to_numpy()
                bounds = np.concatenate(([0], np.cumsum(counts)))
                codes = unpacked(row["places"].as_py())[unpacked(row["codes"].as_py())]
                sizes = np.concatenate([unpacked(x) for x in row["sizes"].as_py()] or [np.zeros(0, "<u4")]).astype(np.int64)
                pool = np.concatenate([unpacked(x) for x in row["ids"].as_py()] or [np.zeros(0, "<u4")])
                at = 0
                while at < len(doc_ids):
                    to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + DECODE_WORDS, "right")) - 1)
                    part, cuts = gather(pool, sizes, codes[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
                    taken = pieces.take(pa.array(part))
                    offs = np.frombuffer(taken.buffers()[1], np.int64)[: len(part) + 1]
                    body = memoryview(taken.buffers()[2] or b"")
                    text = [bytes(body[offs[a] : offs[b]]).decode(errors="replace") for a, b in zip(cuts, cuts[1:], strict=False)]
                    own = [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                    columns = [doc_ids[at:to], np.diff(cuts), [hashlib.sha256(x.tobytes()).hexdigest() for x in own], [hashlib.sha256(x.encode()).hexdigest() for x in text]]
                    columns += [[x.astype(np.int32) for x in own], text] if with_ids else []
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                    at = to

    return rows.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, tokenizer: str | None = None, shards: int | None = None, with_ids: bool = False) -> DataFrame:
    """Encode the documents' texts and decode the ids again. ``shards`` defaults to the shuffle partitions."""
    path = tokenizer or default_tokenizer()
    shards = shards or min(4096, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = bucketed(blocks(rows, path, shards), "word-blocks", "block", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return documents(joined(table, encode_words(table, path)), path, with_ids)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of what they decode to."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
