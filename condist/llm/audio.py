"""Audio features of media columns.

Media are WAV files in a binary column: 8-bit unsigned mono PCM. Features come
from a polyphase resampler (rational factor, windowed-sinc phases), overlapped
log-mel filterbanks and an energy segmentation with hysteresis: a segment
begins above the upper level and ends under the lower one. All are computed in
runs of frames of bounded length, so a long recording needs no more memory
than a few seconds of it. Mel frames are cut into tensors of one shape (half
precision, in steps of 1 / STEPS) and stored with their time spans and the
segments in them; features of recordings are sums over the stored tensors.

Defined cases: a null text is an empty payload, which is padded to one block
of 192 samples; recordings shorter than a frame are padded with silence to
one frame; equal payloads give equal features wherever they are computed; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.llm.scratch import written
from condist.llm.tokens import slices

RATE, UP, DOWN, TAPS = 16_000, 5, 8, 12
FRAME, HOP, MELS, WINDOW = 256, 128, 40, 16
OUT_RATE = RATE * UP // DOWN
#: Frames whose samples are held at once; a multiple of WINDOW.
RUN = 1024
ENTER_DB, LEAVE_DB = -6.0, -9.0
#: Steps of a stored log-mel value in one unit of the natural logarithm; sums of such steps are exact in any order.
STEPS = 32
DIGESTS = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string"}
SPANS = "array<struct<start_s double, end_s double, begins boolean>>"
DIGEST_COLUMNS = ", ".join(f"{k} {t}" for k, t in DIGESTS.items())
TENSORS = f"recording long, doc_id long, window long, start_s double, end_s double, frames int, tensor binary, segments {SPANS}, {DIGEST_COLUMNS}"


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit unsigned mono samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> tuple[memoryview, int]:
    """The samples and rate of such a file."""
    riff, _, kind = struct.unpack_from("<4sI4s", media)
    if riff != b"RIFF" or kind != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return memoryview(media)[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=1)
def phases() -> np.ndarray:
    """Row p: the filter taps, latest input last, of outputs whose position is p / UP after an input."""
    half = TAPS // 2
    t = (np.arange(TAPS)[None, :] - half + 1) - np.arange(UP)[:, None] / UP
    cut = min(1.0, UP / DOWN)
    taps = cut * np.sinc(cut * t) * np.cos(np.pi * np.clip(t / half, -1, 1) / 2) ** 2
    return taps / taps.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Outputs ``first`` to ``last`` (exclusive) of ``x`` (unsigned bytes) at UP / DOWN times its rate; silence around it."""
    out = np.zeros(last - first)
    at = np.arange(first, last) * DOWN
    base, phase = at // UP, at % UP
    low, high = int(base[0]) - TAPS // 2 + 1, int(base[-1]) + TAPS // 2 + 1
    part = (x[max(low, 0) : max(high, 0)].astype(np.float64) - 128) / 128
    part = np.pad(part, (max(-low, 0), high - low - max(-low, 0) - len(part)))
    windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    for p in range(UP):
        own = np.flatnonzero(phase == p)
        if len(own):
            out[own] = windows[base[own] - base[0]] @ phases()[p]
    return out


@lru_cache(maxsize=1)
def filterbank() -> np.ndarray:
    """Triangular mel filters, bins by bands."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)[:, None]
    up, down = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def frame_count(n_samples: int) -> int:
    outputs = -(-n_samples * UP // DOWN)
    return 1 + max(0, -(-(outputs - FRAME) // HOP))


def log_mels(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Log-mel frames and their levels in dB, in runs of RUN frames."""
    total = frame_count(len(x))
    for a in range(0, total, RUN):
        b = min(a + RUN, total)
        y = resample(x, a * HOP, (b - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * np.hanning(FRAME)
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        yield np.log(power @ filterbank() + 1e-8), 10 * np.log10((frames**2).mean(axis=1) + 1e-10)


def segments(levels: np.ndarray, enter: float = ENTER_DB, leave: float = LEAVE_DB) -> list[tuple[int, int]]:
    """Frame spans that begin at ``enter`` dB or more and end before the first frame under ``leave``."""
    mark = np.where(levels >= enter, 1, np.where(levels < leave, -1, 0))
    at = np.flatnonzero(mark)
    if not len(at):
        return []
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    inside = (last >= 0) & (mark[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def media(docs: DataFrame, block: int = 192) -> DataFrame:
    """recording (a number), doc_id, n_bytes, media: each text's UTF-8 bytes as samples, with spaces up to a positive multiple of ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                files = [wav(t.ljust(max(block, -(-len(t) // block) * block))) for t in raw]
                columns = [pa.array(np.arange(number, number + len(raw))), part.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(files, pa.binary())]
                number += len(raw)
                yield pa.record_batch(columns, ["recording", "doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "recording long, doc_id long, n_bytes long, media binary")


def windows_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, bool]]]]:
    """A recording's tensors (the last filled up with silence), the frames that each has, and its segments' frame spans and whether they begin there."""
    runs = [(np.round(mels * STEPS).astype(np.float32) / STEPS, db) for mels, db in log_mels(x)]
    mels, levels = (np.concatenate(v) for v in zip(*((m.astype(np.float16), db) for m, db in runs), strict=True))
    n = -(-len(mels) // WINDOW)
    tensors = np.full((n * WINDOW, MELS), np.round(np.log(1e-8) * STEPS) / STEPS, np.float16)
    tensors[: len(mels)] = mels
    inside: list[list[tuple[int, int, bool]]] = [[] for _ in range(n)]
    for a, b in segments(levels - levels.max()):
        for w in range(a // WINDOW, (b - 1) // WINDOW + 1):
            inside[w].append((max(a, w * WINDOW), min(b, (w + 1) * WINDOW), a >= w * WINDOW))
    return tensors.reshape(n, WINDOW, MELS), np.minimum(WINDOW, len(mels) - WINDOW * np.arange(n)), inside


def tensors(table: DataFrame) -> DataFrame:
    """Log-mel tensors of WINDOW x MELS, half floats row by row in ``tensor``, with their spans in seconds.

    ``segments`` has the segments that overlap the span, cut to it, and whether
    they begin there. A recording's first row has its digests. as_tensors()
    gives the column its Arrow tensor type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("begins", pa.bool_())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.list_(span), *(pa.string() if t == "string" else pa.int64() for t in DIGESTS.values())]
        names = ["recording", "doc_id", "window", "start_s", "end_s", "frames", "tensor", "segments", *DIGESTS]
        seconds = lambda frame: float(frame) * HOP / OUT_RATE
        for batch in batches:
            for part in slices(batch, "media"):
                rows: list[tuple] = []
                for recording, doc_id, n_bytes, file in zip(*(part.column(c).to_pylist() for c in ("recording", "doc_id", "n_bytes", "media")), strict=True):
                    data, _ = samples_of(file)
                    digests = (n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(file), hashlib.sha256(file).hexdigest())
                    for w, (tensor, frames, spans) in enumerate(zip(*windows_of(np.frombuffer(data, np.uint8)), strict=True)):
                        inside = [{"start_s": seconds(a), "end_s": seconds(b), "begins": begins} for a, b, begins in spans]
                        rows.append((recording, doc_id, w, seconds(w * WINDOW), seconds(w * WINDOW + frames), int(frames), tensor.tobytes(), inside, *(digests if not w else [None] * len(digests))))
                    if len(rows) > 4096:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return table.mapInArrow(run, TENSORS)


def as_tensors(column: pa.Array | pa.ChunkedArray) -> pa.ExtensionArray:
    """A read ``tensor`` column as an Arrow fixed-shape tensor array."""
    values = np.frombuffer(b"".join(column.to_pylist()), np.float16)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(values), WINDOW * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float16(), (WINDOW, MELS)), storage)


def features(stored: DataFrame) -> DataFrame:
    """Each recording's doc_id, digests and feature: frames, segments (number, seconds) and mean log-mel by band, from its stored tensors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = batch.column("frames").to_numpy()
            values = as_tensors(batch.column("tensor")).to_numpy_ndarray().astype(np.float32) if len(frames) else np.zeros((0, WINDOW, MELS))
            own = np.arange(WINDOW)[None, :] < frames[:, None]
            sums = (np.round(values * STEPS).astype(np.int64) * own[:, :, None]).sum(axis=1)
            columns = [pa.array(list(sums), pa.list_(pa.int64())) if c == "tensor" else batch.column(c) for c in batch.schema.names]
            yield pa.record_batch(columns, ["sums" if c == "tensor" else c for c in batch.schema.names])

    lengths = F.transform("segments", lambda s: F.round((s["end_s"] - s["start_s"]) * OUT_RATE / HOP).cast("long"))
    begins, active = F.size(F.filter("segments", lambda s: s["begins"])), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b)
    rows = stored.select("recording", "doc_id", *DIGESTS, "frames", begins.alias("begins"), active.alias("active"), "tensor")
    rows = rows.mapInArrow(run, f"recording long, doc_id long, {DIGEST_COLUMNS}, frames int, begins int, active long, sums array<long>")
    per = rows.groupBy("recording").agg(
        *[F.max(c).alias(c) for c in ("doc_id", *DIGESTS)], *[F.sum(c).alias(c) for c in ("frames", "begins", "active")], *[F.sum(F.get("sums", F.lit(k))).alias(f"m{k}") for k in range(MELS)]
    )
    text = F.format_string(
        "frames=%d segments=%d active=%.3f mel=" + ",".join(["%.2f"] * MELS), "frames", "begins", F.col("active") * HOP / OUT_RATE, *[F.col(f"m{k}") / (F.col("frames") * STEPS) for k in range(MELS)]
    )
    return per.select("doc_id", *DIGESTS, text.alias("feature"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all texts as recordings and their tensors, read both back and give digests and features."""
    recordings = written(media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return features(written(tensors(recordings), "tensors"))
