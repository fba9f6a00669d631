"""Packing of token sequences by minimum bin slack.

Documents are cut into whole windows of ``capacity`` tokens; what remains of
each waits in a pool. A window is filled by fixing the longest waiting length
and running a subset-sum over bitsets on the waiting multiset: the sum closest
to the window's capacity wins and the counts behind it are read back from the
kept bitsets. A gap that no multiset closes takes the head of a longer piece.
Each input partition packs its own rows in one pass with a bounded pool: there
is no shuffle, and a lost task repeats with the same result.

Defined cases: a null text counts as empty, an empty text is its end id alone,
a null doc_id is kept, repeated rows are packed once each, an empty table gives
no rows, columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condist.llm.scratch import frugal
from condist.llm.tokens import default_tokenizer, encoder, slices

SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def best_fill(counts: dict[int, int], available: int, gap: int) -> tuple[int, dict[int, int]]:
    """Largest sum of at most ``gap`` from the multiset ``counts``, and how many of each length it takes.

    ``available`` has bit L set for each length L with a count. Lengths enter
    from long to short, in powers of two of their count; each bitset before an
    entry is kept for reading the counts back. An exact fill ends the search.
    """
    mask = (1 << (gap + 1)) - 1
    rest = available & mask & ~1
    reach, steps = 1, []
    while rest and not reach >> gap:
        length = rest.bit_length() - 1
        rest ^= 1 << length
        left, copies = min(counts[length], gap // length), 1
        while left > 0:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            copies *= 2
    total = best = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return best, used


class Packer:
    """Fills windows from pieces ``(key, start, ids)``; emits ``(key, start, ids, sequence, offset, tokens)``."""

    def __init__(self, capacity: int, tolerance: int, emit: Callable[..., None]):
        self.capacity, self.tolerance, self.emit = capacity, tolerance, emit
        self.pool: defaultdict[int, deque] = defaultdict(deque)
        self.counts: dict[int, int] = {}
        self.available, self.waiting, self.sequence = 0, 0, 0

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pool[n].append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.available |= 1 << n
        self.waiting += n

    def take(self, n: int) -> tuple:
        self.counts[n] -= 1
        if not self.counts[n]:
            self.available ^= 1 << n
        self.waiting -= n
        return self.pool[n].popleft()

    def head(self, n: int) -> tuple:
        """The first n tokens of the longest piece; its tail waits on."""
        key, start, ids = self.take(self.available.bit_length() - 1)
        self.put((key, start + n, ids[n:]))
        return key, start, ids[:n]

    def close(self, pieces: list[tuple]) -> None:
        total, at = sum(len(p[2]) for p in pieces), 0
        for key, start, ids in pieces:
            self.emit(key, start, ids, self.sequence, at, total)
            at += len(ids)
        self.sequence += 1

    def add(self, key, ids: np.ndarray) -> None:
        """Whole windows close at once; the remainder waits."""
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.close([(key, start, ids[start : start + self.capacity])])
        if whole < len(ids):
            # a copy, so that what waits does not hold its whole document
            self.put((key, whole, ids[whole:].copy()))

    def drain(self, keep: int) -> None:
        """Fill windows until fewer than ``keep`` tokens wait."""
        while self.waiting >= max(keep, self.capacity):
            pieces = [self.take(self.available.bit_length() - 1)]
            gap = self.capacity - len(pieces[0][2])
            best, used = best_fill(self.counts, self.available, gap)
            pieces += [self.take(n) for n, k in used.items() for _ in range(k)]
            if gap - best > self.tolerance:
                pieces.append(self.head(gap - best))
            self.close(pieces)

    def finish(self) -> None:
        """Pack all that waits; the last tokens go to sequences of a power of two, which need no padding."""
        self.drain(self.capacity)
        while self.waiting:
            room, pieces = 1 << (self.waiting.bit_length() - 1), []
            while room:
                longest = self.available.bit_length() - 1
                pieces.append(self.take(longest) if longest <= room else self.head(room))
                room -= len(pieces[-1][2])
            self.close(pieces)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    tolerance: int = 4,
    pool_tokens: int = 1 << 21,
) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_tokens.

    ``tolerance`` is the slack a closed window may keep, ``pool_tokens`` the
    number of tokens a task holds while it looks for good fills.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        packer = Packer(capacity, tolerance, lambda *row: rows.append(row))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            batch = pa.record_batch(
                [
                    pa.array([k[0] for k in cols[0]], pa.int64()),
                    pa.array(cols[1], pa.int64()),
                    pa.array([x.tobytes() for x in cols[2]], pa.binary()),
                    pa.array([k[1] for k in cols[0]], pa.int64()),
                    pa.array([base + x for x in cols[3]], pa.int64()),
                    pa.array(cols[4], pa.int64()),
                    pa.array(cols[5], pa.int64()),
                ],
                ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"],
            )
            rows.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encoder(path).column(part.column("text"))
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    packer.add((doc_id, len(own)), own)
                packer.drain(pool_tokens)
                yield out()
        packer.finish()
        yield out()
        encoder(path).rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), SCHEMA)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the digest columns of the query's contract."""
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_tokens",
    )
