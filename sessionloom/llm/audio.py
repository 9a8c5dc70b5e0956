"""Media columns: 8-bit audio with log-mel features as fixed-shape Arrow tensors.

``store_media`` writes WAV files (8-bit PCM, one per row) as a binary column in the shared folder and
``audio_features`` computes, from the stored bytes: polyphase resampling by ``UP / DOWN``, overlapped frames,
log-mel filterbanks in patches of ``PATCH`` frames (Arrow's fixed-shape tensor type, as an IPC stream, each patch
with its time span), and segments of high energy by hysteresis; all of it is written too. ``media_digests`` reads the
written tensors and spans. Long files are worked on some thousand frames at a time.

Nulls: a null or empty text is 64 zero samples. Null and repeated ids stay; an empty table gives no rows; other
columns are ignored. Frames past the end are filled with silence.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, slices, stored

RATE, UP, DOWN, TAPS = 8000, 2, 5, 16
FRAME, HOP, MELS, PATCH = 128, 64, 16, 32
BLOCK_FRAMES = 4096
UNIT = 64
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
_MEDIA = "doc_id long,n_bytes long,media binary"


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    return _HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(raw: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a mono 8-bit PCM file."""
    riff, _, wave, fmt, _, pcm, channels, rate, _, _, bits, data, size = _HEADER.unpack_from(raw)
    if (riff, wave, fmt, pcm, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data"):
        raise ValueError("not mono 8-bit PCM")
    return raw[_HEADER.size : _HEADER.size + size], rate


@lru_cache
def _filters(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low pass, one row of ``taps`` coefficients for each of the ``up`` phases."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return (h / h.sum() * up).reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


@lru_cache
def _mel_bank(rate: float, frame: int, mels: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    freqs = np.arange(frame // 2 + 1) * rate / frame
    rise = (freqs[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - freqs[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32).copy()


def resample(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Outputs ``first`` to ``first + count`` of the polyphase filter; silence outside of the samples."""
    bank = _filters(UP, DOWN, TAPS)
    low = first * DOWN // UP - TAPS + 1
    high = (first + count - 1) * DOWN // UP + 1
    x = np.zeros(high - low, dtype=np.float32)
    a, b = max(low, 0), min(high, len(samples))
    if b > a:
        x[a - low : b - low] = (samples[a:b].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty(count, dtype=np.float32)
    for j in range(min(UP, count)):
        n = first + j
        start = n * DOWN // UP - TAPS + 1 - low
        part = windows[start::DOWN][: len(range(j, count, UP))]
        out[j::UP] = part @ bank[n * DOWN % UP]
    return out


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames by filters, in sixteenths of a natural log, whole numbers."""
    n_out = -(-len(samples) * UP // DOWN)
    n_frames = max(1, -(-max(0, n_out - FRAME) // HOP) + 1)
    bank, window = _mel_bank(RATE * UP / DOWN, FRAME, MELS), np.hanning(FRAME).astype(np.float32)
    parts = []
    for at in range(0, n_frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, n_frames - at)
        y = resample(samples, at * HOP, (n - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        spectrum = np.fft.rfft(frames, axis=1)
        parts.append(np.rint(16 * np.log((spectrum.real**2 + spectrum.imag**2) @ bank + 1e-6)).astype(np.int16))
    return np.concatenate(parts)


def loud_spans(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that begin above the upper and end below the lower energy threshold."""
    energy = mel.sum(axis=1, dtype=np.int64)
    middle, spread = int(energy.mean()), int(energy.std()) // 4
    mark = np.where(energy > middle + spread, 1, np.where(energy < middle - spread, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), 0))
    on = np.concatenate([[0], np.maximum(mark[known], 0), [0]])
    edges = np.flatnonzero(np.diff(on))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def millis(frame: int) -> int:
    return frame * HOP * DOWN * 1000 // (UP * RATE)


def tensor_stream(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream: ``start_ms``, ``end_ms`` and ``log_mel``, a fixed-shape tensor of PATCH x MELS."""
    n = -(-len(mel) // PATCH)
    padded = np.full((n * PATCH, MELS), int(16 * np.log(1e-6)), dtype=np.float32)
    padded[: len(mel)] = mel
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray((padded / 16).reshape(n, PATCH, MELS)))
    starts = [millis(k * PATCH) for k in range(n)]
    ends = [millis(min((k + 1) * PATCH, len(mel))) for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), tensor], names=["start_ms", "end_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store_media(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes, media: each text as UTF-8, filled with zero bytes to a positive multiple of ``unit``, as WAV; written and opened again."""
    schema = arrow_schema(_MEDIA)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw = [(t or "").encode() for t in part["text"]]
            wavs = [to_wav(r.ljust(max(1, -(-len(r) // unit)) * unit, b"\0")) for r in raw]
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "n_bytes": [len(r) for r in raw], "media": wavs}, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(encode, _MEDIA), "media")


def from_tensor_stream(raw: bytes) -> np.ndarray:
    """Frames by filters of a stored stream, without the frames that fill the last patch; the time spans say how many."""
    table = pa.ipc.open_stream(raw).read_all()
    patches = table["log_mel"].combine_chunks().to_numpy_ndarray()
    frames = table["end_ms"][-1].as_py() // millis(1)
    return np.rint(16 * patches.reshape(-1, MELS)[:frames]).astype(np.int16)


_SEGMENTS = "array<struct<start_ms:long,end_ms:long>>"
_STORED = "doc_id long,n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string"


def audio_features(media: DataFrame) -> DataFrame:
    """For each stored file what its bytes hold, its tensors (an Arrow stream) and its loud segments with their time spans; written and opened again."""
    struct_type = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    schema = pa.schema([*arrow_schema(_STORED), ("tensors", pa.binary()), ("segments", struct_type)])

    def features(doc_id: int | None, n_bytes: int, wav: bytes) -> tuple:
        payload, _ = from_wav(wav)
        mel = log_mel(np.frombuffer(payload, np.uint8))
        spans = [{"start_ms": millis(a), "end_ms": millis(b)} for a, b in loud_spans(mel)]
        return (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), tensor_stream(mel), spans)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = [features(*row) for row in zip(part["doc_id"], part["n_bytes"], part["media"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return stored(media.mapInArrow(compute, f"{_STORED},tensors binary,segments {_SEGMENTS}"), "audio-features")


def media_digests(features: DataFrame) -> DataFrame:
    """What the stored files hold, and ``feature``, a digest of the stored tensors and time spans."""
    schema = arrow_schema(f"{_STORED},feature string")
    kept = schema.names[:-1]

    def feature(raw: bytes, segments: list[dict]) -> str:
        mel = from_tensor_stream(raw)
        spans = [(s["start_ms"] // millis(1), s["end_ms"] // millis(1)) for s in segments]
        loud = sum(b - a for a, b in spans)
        return f"frames={len(mel)};patches={-(-len(mel) // PATCH)}x{PATCH}x{MELS};mean={mel.mean(dtype=np.float64):.3f};segments={len(spans)};loud={loud};spans_crc={zlib.crc32(np.array(spans, '<i8').tobytes()):08x};mel_crc={zlib.crc32(mel.tobytes()):08x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            found = [feature(raw, segments) for raw, segments in zip(part["tensors"], part["segments"], strict=True)]
            yield pa.RecordBatch.from_pydict({c: part[c] for c in kept} | {"feature": found}, schema=schema)

    return features.mapInArrow(run, f"{_STORED},feature string")


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` stored as audio; tensors and time spans stored beside them, read back and digested; one row per document."""
    return media_digests(audio_features(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


QUERIES = {"op10_audio": op10_audio}
