"""Byte-level BPE over Arrow columns, shared by the token operators.

A column's words are cut for a whole Arrow batch at once: every character gets
one of four classes, and a token starts where the classes say so. The words
then form a string array over the batch's own bytes, which Arrow dictionary
encodes, so only words that a worker has not met yet reach the tokenizer.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SPACE, LETTER, NUMBER, OTHER = range(4)
#: New words after which a worker forgets those not met since the last such time; twice as many bound its memory.
CACHE_WORDS = 150_000
#: Words that a worker still remembers when its task ends: those met first, and so the frequent ones mostly.
KEPT_WORDS = 50_000
#: Bytes of text that are cut and encoded at once.
SLICE_BYTES = 2 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for run in regex.finditer(pattern, points):
            a, b = ord(points[run.start()]), ord(points[run.end() - 1])
            table[a : b + 1] = kind  # surrogates inside a run cannot occur in UTF-8
    return table


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer of a string column without nulls, and its n + 1 offsets into it."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def byte_strings(column: pa.Array) -> list[bytes]:
    """The strings of a column without nulls, as bytes."""
    body, offsets = flat(column)
    data, ends = body.tobytes(), offsets.tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def cut_words(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the words of all texts start.

    The cut is that of the public byte-level pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    is_char = (body & 0xC0) != 0x80
    at = np.flatnonzero(is_char)
    points = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:-1][at]  # of its text
    last = np.append(first[1:], True)
    before = np.concatenate(([SPACE], kind[:-1]))
    after = np.append(kind[1:], SPACE)
    space = kind == SPACE
    blank_before = np.concatenate(([False], points[:-1] == 32)) & ~first
    start = first | ((kind != before) & ~(~space & blank_before)) | (space & ~last & (after != SPACE))
    quotes = np.flatnonzero((points == 39) & start & ~last & (after == LETTER))
    if len(quotes):
        p = np.append(points, [0, 0])
        ends = np.append(last, [True, True])
        a, b = p[quotes + 1], p[quotes + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        two = ~short & ~ends[quotes + 1] & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        for hit, size in ((short, 2), (two, 3)):
            q = quotes[hit]
            start[q + 1] = False
            start[(q + size)[q + size < len(start)]] = True
    return at[start]


class Encoder:
    """Encodes columns with one tokenizer file, remembering words it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special_ids = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(self.special_ids)
        self.special_words = {k.encode(): array("I", [v]).tobytes() for k, v in self.special_ids.items()}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.alphabet = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}

    def word(self, word: bytes) -> bytes:
        """Ids of one cut word, by the tokenizer's own merges, as unsigned 32-bit integers."""
        special = self.special_words.get(word)
        if special is not None:
            return special
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.alphabet))]).tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Words met lately are remembered, so frequent ones are encoded once."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = older.get(w)
                known[w] = ids = self.word(w) if ids is None else ids
            out.append(ids)
        return out

    def rest(self) -> None:
        """Forget most words: a worker between tasks leaves the memory to others."""
        self.known, self.older = dict(islice((self.older or self.known).items(), KEPT_WORDS)), {}

    def pieces(self) -> pa.Array:
        """The bytes of each id."""
        back = {v: k for k, v in self.alphabet.items()}
        out = []
        for i in range(self.tokenizer.get_vocab_size()):
            token = self.tokenizer.id_to_token(i)
            out.append(bytes(back[ord(c)] for c in token) if all(ord(c) in back for c in token) else token.encode())
        return pa.array(out, pa.large_binary())

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts end to end, dictionary encoded, and n + 1 offsets; null is empty.

        A special token's string is a word of its own, and what stands before
        and after it is cut as if it were a text.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        rows, bounds, whole = self._segments(texts)
        body, offsets = flat(rows)
        starts = cut_words(body, offsets)
        if len(whole):
            inner = np.zeros(len(body) + 1, bool)
            inner[spread(offsets[whole] + 1, offsets[whole + 1] - offsets[whole] - 1)] = True
            starts = starts[~inner[starts]]
        edges = pa.py_buffer(np.append(starts, len(body)).astype(np.int64))
        words = pa.LargeStringArray.from_buffers(len(starts), edges, pa.py_buffer(body.tobytes()))
        return words.dictionary_encode(), np.searchsorted(starts, offsets)[bounds]

    def _segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Rows to cut, the n + 1 rows at which texts begin, and the rows that are special tokens."""
        n = len(texts)
        marked = np.zeros(n, bool)
        for token in self.special:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not marked.any():
            return texts, np.arange(n + 1), np.zeros(0, np.int64)
        pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        rows: list[str] = []
        bounds, whole = [0], []
        for text in texts.to_pylist():
            for k, part in enumerate(pattern.split(text)):
                if k % 2:
                    whole.append(len(rows))
                if part:
                    rows.append(part)
            bounds.append(len(rows))
        return pa.array(rows, pa.large_string()), np.array(bounds), np.array(whole, np.int64)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and n + 1 offsets; null is empty."""
        coded, bounds = self.cut(texts)
        lists = self.words(byte_strings(coded.dictionary))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        pool = np.frombuffer(b"".join(lists), np.uint32)
        codes = coded.indices.to_numpy()
        return gather(pool, sizes, codes, bounds)


def gather(pool: np.ndarray, sizes: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``pool`` (their sizes by code) in the order of ``codes``, and ``bounds`` (of codes) as bounds of the result."""
    if not len(codes):
        return pool[:0], np.zeros(len(bounds), np.int64)
    per_code = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(per_code)))
    return pool[spread((np.cumsum(sizes) - sizes)[codes], per_code)], ends[bounds]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of runs of the given sizes, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
