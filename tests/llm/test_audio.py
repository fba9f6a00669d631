import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from condist.llm import audio
from condist.llm.scratch import written


def padded(text):
    b = (text or "").encode()
    return b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))


def test_files_are_wav():
    with wave.open(io.BytesIO(audio.wav(bytes(range(192))))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(192)) == (1, 1, 16000, bytes(range(192)))


def plain_resample(x, n):
    """Each output by the sum over its taps."""
    half, out = audio.TAPS // 2, []
    for i in range(n):
        base, phase = divmod(i * audio.DOWN, audio.UP)
        taps = audio.phases()[phase]
        values = [(float(x[base + k - half + 1]) - 128) / 128 if 0 <= base + k - half + 1 < len(x) else 0.0 for k in range(audio.TAPS)]
        out.append(sum(a * b for a, b in zip(taps, values, strict=True)))
    return np.array(out)


def test_resampler():
    x = np.random.default_rng(1).integers(0, 256, 700).astype(np.uint8)
    whole = plain_resample(x, 437)
    assert np.allclose(audio.resample(x, 0, 437), whole) and np.allclose(audio.resample(x, 100, 250), whole[100:250])
    t = np.arange(16000) / 16000
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8)
    y = audio.resample(tone, 0, 10000)
    assert np.abs(y[50:-50] - 100 / 128 * np.sin(2 * np.pi * 1000 * np.arange(10000) / 10000)[50:-50]).max() < 0.05
    mels = next(iter(audio.log_mels(tone)))[0]
    centre = audio.filterbank()[round(1000 / audio.OUT_RATE * audio.FRAME)].argmax()
    assert abs(int(mels[10].argmax()) - int(centre)) <= 1


@pytest.mark.parametrize("n", [192, 384, 5760, 400_000])
def test_runs_do_not_change_frames(n, monkeypatch):
    x = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    one = [np.concatenate(v) for v in zip(*audio.log_mels(x), strict=True)]
    assert len(one[0]) == audio.frame_count(n)
    monkeypatch.setattr(audio, "RUN", 128)
    two = [np.concatenate(v) for v in zip(*audio.log_mels(x), strict=True)]
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])


def test_hysteresis():
    levels = np.array([-20, -8, -5, -7, -8.5, -9.5, -8, -6, -6, -30, -6.0])
    assert audio.segments(levels) == [(2, 5), (7, 9), (10, 11)]
    assert audio.segments(np.full(5, -7.0)) == []


def plain_feature(x):
    """The feature of a recording by one look at all its frames."""
    mels, levels = (np.concatenate(v) for v in zip(*audio.log_mels(x), strict=True))
    steps = np.round(np.round(mels * audio.STEPS).astype(np.float32).astype(np.float64)).sum(axis=0)
    found = audio.segments(levels - levels.max())
    active = sum(b - a for a, b in found) * audio.HOP / audio.OUT_RATE
    return f"frames={len(mels)} segments={len(found)} active={active:.3f}", steps / len(mels) / audio.STEPS


def test_whole_table_and_edges(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "x", "y", 1), (-2, "", "x", "y", 1), (-3, "é" * 96, "x", "y", 1), (-4, "s" * 700_000, "x", "y", 1), (-5, "tie", "x", "y", 1), (-5, "tie", "x", "y", 1), (None, "tie", "x", "y", 1)], docs.schema)
    both = docs.union(extra).repartition(3)
    texts = {r.doc_id: r.text for r in both.collect()}
    rows = audio.features(written(audio.tensors(written(audio.media(both), "media")), "tensors")).collect()
    assert len(rows) == docs.count() + 7
    by_payload = {}
    for r in rows:
        p = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((texts[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-16:]) and r.media_bytes == len(p) + 44 and r.media_sha256 == hashlib.sha256(audio.wav(p)).hexdigest()
        assert by_payload.setdefault(p, r.feature) == r.feature
        head, mel = r.feature.split(" mel=")
        want, means = plain_feature(np.frombuffer(p, np.uint8))
        assert head == want and np.allclose([float(x) for x in mel.split(",")], means, atol=0.0051)
    assert audio.features(audio.tensors(audio.media(docs.limit(0)))).collect() == []
    assert [r.feature for r in audio.op9_audio(spark, d).limit(1).collect()][0].count(",") == audio.MELS - 1


def test_tensors(spark):
    df = spark.createDataFrame([(1, "abc " * 9000), (2, "x")], "doc_id long, text string")
    table = audio.tensors(audio.media(df)).orderBy("doc_id", "window").toArrow()
    got = audio.as_tensors(table.column("tensor"))
    assert got.type.shape == [audio.WINDOW, audio.MELS] and got.to_numpy_ndarray().shape == (table.num_rows, audio.WINDOW, audio.MELS)
    spans = table.filter(pa.compute.equal(table["doc_id"], 1)).to_pylist()
    assert all(a["end_s"] == b["start_s"] for a, b in zip(spans, spans[1:], strict=False))
    assert all(s["start_s"] <= g["start_s"] < g["end_s"] <= s["end_s"] for s in spans for g in s["segments"])
    mels = np.concatenate([m for m, _ in audio.log_mels(np.frombuffer(padded("abc " * 9000), np.uint8))])
    stored = got.to_numpy_ndarray()[: len(spans)].reshape(-1, audio.MELS)[: len(mels)]
    assert np.abs(stored - mels).max() <= 0.5 / audio.STEPS + 1e-3
