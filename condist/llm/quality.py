"""Quality classifier: random Fourier features over document statistics.

A document becomes a short vector of shares (letters, symbols, repeated words
and the like). Random Fourier features approximate a Gaussian kernel over the
standardised vectors; ridge weights solve normal equations that are summed by
partition; pool-adjacent-violators on a part of the sample that the weights
did not see turns the ridge score into a probability.

Defined cases: a null text counts as empty, an empty text has a score like any
other (its statistics are zero); null doc_ids are scored and not held out;
repeated rows get equal scores; with no label to learn from every score is
0.5; an empty table gives no rows; further columns are kept as they are, also
ones named score, which the new column replaces only in the result's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condist.llm import labelled
from condist.llm.scratch import frugal
from condist.llm.tokens import flat, slices

#: Byte classes of the statistics.
LOWER, UPPER, DIGIT, BLANK, NEWLINE, STOP, LOUD, PIPE, QUOTE, SYMBOL, WIDE, TAIL = range(12)
NAMES = (
    "lower upper digit blank newline stop loud pipe quote symbol wide accented_upper "
    "repeats distinct top_word word_length words bytes line_words same_lines"
).split()


def _byte_classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.int64)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), (" \t", BLANK), ("\n\r\x0b\x0c", NEWLINE), (".,;:", STOP), ("!?", LOUD), ("|", PIPE), ("'\"()[]-", QUOTE)):
        table[[ord(c) for c in chars]] = kind
    table[0x80:0xC0] = TAIL
    table[0xC0:] = WIDE
    return table


CLASSES = _byte_classes()


def _pieces(body: np.ndarray, first: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs between ``breaks`` (equal runs, equal codes) and where they start."""
    inside = ~breaks
    starts = np.flatnonzero(inside & (first | np.concatenate(([True], breaks[:-1]))))
    ends = np.flatnonzero(inside & np.append(first[1:] | breaks[1:], True)) + 1
    if not len(starts):
        return np.zeros(0, np.int64), starts
    # runs do not touch, so the gaps between them are taken as runs too and dropped again
    bounds = np.empty(2 * len(starts) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = starts, ends, len(body)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body.tobytes())])
    coded = runs.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), starts


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    body, offsets = flat(texts)
    n, sizes = len(texts), np.diff(offsets)
    out = np.zeros((n, len(NAMES)))
    if not len(body):
        return out
    doc = np.repeat(np.arange(n), sizes)
    kind = CLASSES[body]
    counts = np.bincount(doc * 12 + kind, minlength=12 * n).reshape(n, 12)
    chars = sizes - counts[:, TAIL]
    out[:, :11] = counts[:, :11] / np.maximum(chars, 1)[:, None]
    capital = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E))
    out[:, 11] = _share(np.bincount(doc[capital], minlength=n), chars)
    first = np.zeros(len(body) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    folded = np.where(kind == UPPER, body + 32, body).astype(np.uint8)
    codes, starts = _pieces(folded, first, (kind == BLANK) | (kind == NEWLINE))
    owner = doc[starts]
    words = np.bincount(owner, minlength=n)
    if len(codes):
        same = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        width = int(codes.max()) + 1
        pairs, often = np.unique(owner * width + codes, return_counts=True)
        out[:, 12] = _share(np.bincount(owner[1:][same], minlength=n), words)
        distinct = np.bincount(pairs // width, minlength=n)
        out[:, 13] = np.log1p(distinct) / np.log1p(np.maximum(words, 1))
        top = np.zeros(n)
        np.maximum.at(top, pairs // width, often)
        out[:, 14] = _share(top, words)
        spaces = counts[:, BLANK] + counts[:, NEWLINE]
        out[:, 15] = np.minimum(_share(chars - spaces, words), 50) / 10
    out[:, 16] = np.log1p(words) / 10
    out[:, 17] = np.log1p(sizes) / 15
    out[:, 18] = np.log1p(_share(words, counts[:, NEWLINE] + 1)) / 10
    codes, starts = _pieces(folded, first, kind == NEWLINE)
    if len(codes):
        owner, width = doc[starts], int(codes.max()) + 1
        kept = np.bincount(np.unique(owner * width + codes) // width, minlength=n)
        all_lines = np.bincount(owner, minlength=n)
        out[:, 19] = _share(all_lines - kept, all_lines)
    return out


@dataclass(frozen=True)
class Model:
    """Ridge weights over random Fourier features and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over cells in ascending ``x``: knots and non-decreasing levels."""
    blocks: list[list[float]] = []
    for value, k, n in zip(x, ones, counts, strict=True):
        blocks.append([value * n, k, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 5,
    held_out: int = 0,
    per_class: int = 10_000,
    dimension: int = 256,
    ridge: float = 1e-3,
    cells: int = 1000,
    seed: int = 7,
) -> Model:
    """Learn from at most ``per_class`` labelled documents of each class.

    Rows with remainder ``held_out`` are left out. Of the others, those with
    the next remainder fit the calibration and the rest the weights. Classes
    are weighted to their shares among all labels.
    """
    fold = labelled.remainder(modulus)
    use = fold != held_out
    chosen = labelled.sample(docs, labels, "quality", use, per_class).withColumn("calibrate", fold == (held_out + 1) % modulus)
    share = labelled.prior(labels, "quality", use)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                stats = statistics(part.column("text"))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.record_batch([lists, part.column("label"), part.column("calibrate")], ["stats", "label", "calibrate"])

    # the sample is bounded, and so is this table of its statistics
    stats = chosen.mapInArrow(frugal(measure), "stats array<double>, label int, calibrate boolean").repartition(8).persist()
    moments = stats.agg(
        F.array(*[F.avg(F.col("stats")[i]) for i in range(len(NAMES))]).alias("mean"),
        F.array(*[F.stddev_pop(F.col("stats")[i]) for i in range(len(NAMES))]).alias("scale"),
        F.sum("label").alias("ones"),
        F.count("*").alias("n"),
    ).first()
    if not moments["n"]:
        empty = np.zeros(0)
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros((len(NAMES), 1)), np.zeros(1), np.zeros(1), empty, empty)
    mean, scale = np.array(moments["mean"]), np.array(moments["scale"])
    scale[scale < 1e-6] = 1.0
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / np.sqrt(len(NAMES)), (len(NAMES), dimension))
    base = Model(mean, scale, directions, rng.uniform(0, 2 * np.pi, dimension), np.zeros(dimension), np.zeros(0), np.zeros(0))
    ones = moments["ones"] / moments["n"]
    weight = {1: share / max(ones, 1e-9), 0: (1 - share) / max(1 - ones, 1e-9)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros((dimension, dimension + 1))
        for batch in batches:
            z = base.features(_matrix(batch.column("stats")))
            y = batch.column("label").to_numpy()
            w = np.where(y == 1, weight[1], weight[0])
            left += (z * w[:, None]).T @ np.column_stack((z, y))
        yield pa.record_batch([pa.array(np.arange(dimension)), pa.array(list(left), pa.list_(pa.float64()))], ["i", "row"])

    total = np.zeros((dimension, dimension + 1))
    for r in stats.where(~F.col("calibrate")).mapInArrow(frugal(sums), "i long, row array<double>").toLocalIterator():  # 8 matrices
        total[r.i] += r.row
    weights = np.linalg.solve(total[:, :-1] + ridge * (np.trace(total[:, :-1]) / dimension + 1e-9) * np.eye(dimension), total[:, -1])
    model = Model(mean, scale, directions, base.phases, weights, np.zeros(0), np.zeros(0))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor(np.clip(model.raw(_matrix(batch.column("stats"))), -1, 2) * cells)
            yield pa.record_batch([pa.array(at.astype(np.int64)), batch.column("label")], ["cell", "label"])

    found = stats.where("calibrate").mapInArrow(frugal(cell), "cell long, label int").groupBy("cell").agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
    table = np.array(sorted((r["cell"], r["ones"], r["n"]) for r in found.collect()), float).reshape(-1, 3)  # at most 3 * cells
    stats.unpersist()
    if not len(table):
        table = np.array([[0, 0, 1], [cells, 1, 1]], float)
    k, n = table[:, 1] * weight[1], table[:, 1] * weight[1] + (table[:, 2] - table[:, 1]) * weight[0]
    knots, levels = isotonic((table[:, 0] + 0.5) / cells, k, n)
    return Model(mean, scale, directions, base.phases, weights, knots, levels)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name``; a column of that name is replaced."""
    kept = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = pa.array(model.score(statistics(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, name])

    return kept.mapInArrow(frugal(run), schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; labels with remainder 0 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decided(score(docs, model), labelled.remainder(5) == 0)


def decided(scored: DataFrame, held_out, threshold: float = 0.3) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
