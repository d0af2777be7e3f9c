"""Audio media columns.

A payload of bytes is stored without loss as 8-bit mono samples in a WAV file. The stored bytes are read back, and from
their samples come: polyphase resampling, overlapped log-mel filterbanks cut into tensors of one fixed shape with the
span of time that each covers, and segments of sound by an energy threshold with hysteresis.

The tensors are stored as Arrow's own: a row's column holds an Arrow stream with one row for each tensor (type
arrow.fixed_shape_tensor, frames by bands) and the span that it covers. Whatever reads the table, from Parquet too, gets
the typed tensors back by opening the stream (stored_tensors), as Spark's columns have no such type.

Defined results: null text counts as empty, whose payload is BLOCK zero bytes; repeated rows each give a row; an empty
table gives none; equal texts give equal values, as each text is worked on alone and results are rounded. Long texts are
worked on whole; the last tensor is filled up with the floor value. Other columns than the two named are ignored,
whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumora.llm.common import parts

#: A payload's length is a positive multiple of this.
BLOCK = 64
#: Samples a second as stored and as analysed; frame, hop and transform in samples; mel bands; frames in a tensor.
STORED_HZ, HZ, FRAME, HOP, FFT, MELS, FRAMES = 16000, 8000, 200, 100, 256, 24, 64
#: Decibels at which a segment begins, and below which it ends; the floor of the filterbanks.
BEGIN_DB, END_DB, FLOOR_DB = -14.0, -18.0, -80.0


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data + bytes(max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def to_wav(payload: bytes, hz: int = STORED_HZ) -> bytes:
    """8-bit samples, one channel, as a RIFF file."""
    pad = b"\0" * (len(payload) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, hz, hz, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload) + len(pad), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + pad


def from_wav(media: bytes) -> tuple[int, int, int]:
    """Sample rate, and where the samples begin and end."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, hz = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            coding, channels, hz, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono samples")
        elif kind == b"data":
            return hz, at + 8, at + 8 + size
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(8)
def _taps(up: int, down: int, width: int = 8) -> np.ndarray:
    """A windowed-sinc low-pass filter, as one row for each of the `up` phases."""
    n = 2 * width * max(up, down) + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(up, down)) * np.blackman(n)
    h *= up / h.sum()
    per = -(-n // up)
    return np.ascontiguousarray(np.pad(h, (0, per * up - n)).reshape(per, up).T[:, ::-1], np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up/down times its rate; output n takes phase (n * down) mod up of the filter."""
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    if up == down:
        return x.astype(np.float32)
    taps = _taps(up, down)
    per, n = taps.shape[1], -(-len(x) * up // down)
    delay = (2 * 8 * max(up, down) + 1) // 2
    wide = np.pad(x.astype(np.float32), (per, per + down + 1))
    windows = np.lib.stride_tricks.sliding_window_view(wide, per)
    out = np.empty(n, np.float32)
    for r in range(min(up, n)):
        first = r * down + delay
        k = len(range(r, n, up))
        start = first // up + 1  # one window ends at the sample that the phase's newest tap meets
        out[r::up] = windows[start : start + (k - 1) * down + 1 : down][:k] @ taps[first % up]
    return out


@lru_cache(4)
def _mel(hz: int, fft: int, mels: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, (fft / 2 + 1, mels)."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(20.0), to_mel(hz / 2), mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1)[:, None] * hz / fft
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Decibels by frame and band; frames overlap by half, the last is filled up with zeros."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, FRAME + (n - 1) * HOP - min(len(x), FRAME + (n - 1) * HOP)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    out = np.empty((n, MELS), np.float32)
    window, mel = np.hanning(FRAME).astype(np.float32), _mel(HZ, FFT, MELS)
    for lo in range(0, n, 1024):
        spectrum = np.fft.rfft(frames[lo : lo + 1024] * window, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[lo : lo + 1024] = 10 * np.log10(np.maximum(power @ mel / FRAME, 1e-8))
    return out


def segments(x: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame (exclusive) of each stretch that begins above BEGIN_DB and lasts until below END_DB."""
    n = max(1, len(x) // HOP)
    level = 10 * np.log10(np.add.reduceat(np.square(x, dtype=np.float64), np.arange(n) * HOP)[:n] / HOP + 1e-12) if len(x) >= HOP else np.full(1, FLOOR_DB)
    level = np.round(level, 3)
    mark = np.where(level > BEGIN_DB, 1, np.where(level < END_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(n), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[last] > 0), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(media: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (n, FRAMES, MELS) in hundredths of decibels, the seconds each covers, and the segments in seconds."""
    hz, lo, hi = from_wav(media)
    x = resample((np.frombuffer(media, np.uint8, hi - lo, lo).astype(np.float32) - 128) / 128, HZ, hz)
    bands = np.clip(np.rint(log_mel(x) * 20) * 5, FLOOR_DB * 100, 12000).astype(np.int16)
    n = -(-len(bands) // FRAMES)
    tensors = np.full((n * FRAMES, MELS), FLOOR_DB * 100, np.int16)
    tensors[: len(bands)] = bands
    step = FRAMES * HOP / HZ
    spans = [(k * step, min(len(x) / HZ, (k + 1) * step)) for k in range(n)]
    return tensors.reshape(n, FRAMES, MELS), spans, [(a * HOP / HZ, b * HOP / HZ) for a, b in segments(x)]


_TENSOR = pa.fixed_shape_tensor(pa.int16(), [FRAMES, MELS])
_STORED = pa.schema([("tensor", _TENSOR), ("begin", pa.float64()), ("end", pa.float64())])


def as_stored(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """Tensors (n, FRAMES, MELS) and their spans as an Arrow stream."""
    out = pa.BufferOutputStream()
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), FRAMES * MELS)
    begins, ends = ([s[k] for s in spans] for k in (0, 1))
    with pa.ipc.new_stream(out, _STORED) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(_TENSOR, flat), pa.array(begins, pa.float64()), pa.array(ends, pa.float64())], schema=_STORED))
    return out.getvalue().to_pybytes()


def stored_tensors(data: bytes) -> pa.Table:
    """What as_stored wrote: columns tensor (fixed-shape tensors), begin, end (seconds)."""
    return pa.ipc.open_stream(data).read_all()


def extract(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, media (the WAV file), data_at (where its samples begin), payload_bytes, tensors (an Arrow
    stream of fixed-shape tensors and their spans; see stored_tensors), spans and segments (arrays of begin and end in seconds)."""
    span = T.ArrayType(T.StructType([T.StructField("begin", T.DoubleType()), T.StructField("end", T.DoubleType())]))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("data_at", T.IntegerType()), T.StructField("payload_bytes", T.LongType()), T.StructField("tensors", T.BinaryType()), T.StructField("spans", span), T.StructField("segments", span)])
    arrow = to_arrow_schema(schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, text, 256):
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                media = to_wav(payload_of(t))
                tensors, spans, segments = features(media)
                _, begin, end = from_wav(media)
                as_dicts = lambda x: [{"begin": a, "end": b} for a, b in x]
                rows.append((doc, len((t or "").encode("utf-8")), media, begin, end - begin, as_stored(tensors, spans), as_dicts(spans), as_dicts(segments)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(key, text).mapInArrow(run, schema)


def digests(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of extract()'s result; the payload is read back from the stored file."""
    payload = F.substring("media", F.col("data_at") + 1, F.col("payload_bytes").cast("int"))
    return extracted.withColumn("_payload", payload).select(
        key,
        "n_bytes",
        "payload_bytes",
        F.sha2("_payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("_payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("tensors="), F.size("spans").cast("string"), F.lit(f"x{FRAMES}x{MELS}")), F.concat(F.lit("segments="), F.size("segments").cast("string")), F.concat(F.lit("sha256="), F.sha2(F.concat("tensors", F.encode(F.to_json("segments"), "UTF-8")), 256))).alias("feature"),
    )
