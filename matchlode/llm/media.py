"""Media columns: bytes kept as 8-bit audio, and audio features in tensors of fixed shape.

A payload is stored as the samples of an 8-bit mono WAV file. Features are computed from the bytes
read back: samples are resampled 4 : 3 by a polyphase filter, cut into overlapped windows, and
turned into log-mel energies, which are averaged over TIMES equal spans of time: a TIMES x BANDS
tensor. Segments are found by energy with hysteresis: a segment holds a frame above the upper
threshold and lasts while frames stay above the lower one.

Defined results: null and empty payloads are one unit of zero bytes; equal payloads give equal
files and features, whatever batch they come in; other columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import pieces

UNIT = 64
RATE, UP, DOWN, TAPS = 8000, 3, 4, 8
WINDOW, HOP, POINTS = 150, 60, 256
TIMES, BANDS = 16, 20
AXES = ("time", "band")
#: Above the median frame energy, in log10 units.
UPPER, LOWER = 0.10, 0.03
#: Frames that are held at once.
FRAMES = 1 << 14


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@cache
def _filter() -> np.ndarray:
    """A windowed sinc, cut off at the lower of both rates, by phase."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h * UP / h.sum()).astype(np.float32).reshape(TAPS, UP).T.copy()


def resample(x: np.ndarray) -> np.ndarray:
    """UP / DOWN as many samples: output n uses phase n * DOWN mod UP of the filter."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(1, np.float32)])
    out = np.empty(n, np.float32)
    for first in range(min(UP, n)):
        phase, start = first * DOWN % UP, first * DOWN // UP
        count = len(range(first, n, UP))
        y = np.zeros(count, np.float32)
        for k in range(TAPS):  # tap k weighs the sample k before
            at = start + TAPS - 1 - k
            y += _filter()[phase, k] * padded[at : at + (count - 1) * DOWN + 1 : DOWN]
        out[first::UP] = y
    return out


@cache
def _mel() -> np.ndarray:
    """Triangles, evenly spaced in mel, over the bins of the spectrum."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    bins = np.arange(POINTS // 2 + 1) * rate / POINTS
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@cache
def _window() -> np.ndarray:
    return np.hanning(WINDOW + 2)[1:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    if len(x) < WINDOW:
        x = np.pad(x, (0, WINDOW - len(x)))
    frames = sliding_window_view(x, WINDOW)[::HOP]
    out = []
    for lo in range(0, len(frames), FRAMES):
        spectrum = np.fft.rfft(frames[lo : lo + FRAMES] * _window(), POINTS)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out.append(np.log10(power @ _mel() + np.float32(1e-6)))
    return np.concatenate(out)


def segments(energy: np.ndarray) -> np.ndarray:
    """First and last frame of each segment."""
    level = np.median(energy)
    low = np.r_[False, energy > level + LOWER, False]
    change = np.flatnonzero(low[1:] != low[:-1]).reshape(-1, 2)
    highs = np.r_[0, np.cumsum(energy > level + UPPER)]
    return change[highs[change[:, 1]] > highs[change[:, 0]]] - [0, 1] if len(change) else change


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The tensor (TIMES, BANDS), and the first and last second of each segment."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    cuts = np.linspace(0, len(mel), TIMES + 1).astype(int)
    sums = np.concatenate([np.zeros((1, BANDS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    n = np.diff(cuts)[:, None]
    means = np.divide(sums[cuts[1:]] - sums[cuts[:-1]], n, out=np.zeros((TIMES, BANDS)), where=n > 0)
    rate = RATE * UP / DOWN
    spans = segments(mel.mean(axis=1)) * HOP / rate
    if len(spans):
        spans[:, 1] += WINDOW / rate
    return np.round(means, 3).astype(np.float32), np.round(spans, 4)


def store_audio(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text), media (a WAV file of its bytes, padded with zeros to whole units)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            files = [to_wav(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b"\0")) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary())], names=["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def read_audio(media: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and media, payload (bytes read back), tensor (an Arrow tensor of TIMES x BANDS numbers), spans (seconds).

    Spark has no tensor type: a cell of `tensor` is Arrow's own serialised form, with shape and axes;
    read_tensor reads one, tensor_table turns the column into one fixed-shape tensor array.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    kinds = [media.schema[c].dataType.simpleString() for c in keep]
    span = pa.list_(pa.struct([("begin", pa.float64()), ("end", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", rows=256):
            payloads = [from_wav(m) for m in batch.column("media").to_pylist()]
            found = [features(p) for p in payloads]
            flat = np.concatenate([s for _, s in found])
            spans = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(len(s) for _, s in found)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.float64()), pa.array(flat[:, 1], pa.float64())], fields=list(span.value_type)),
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), batch.column("media"), pa.array(payloads, pa.binary()), pa.array([tensor_bytes(t) for t, _ in found], pa.binary()), spans],
                names=[*names, "media", "payload", "tensor", "spans"],
            )

    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "media binary, payload binary, tensor binary, spans array<struct<begin:double,end:double>>"])
    rows = media.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), "media")
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "media", "payload", "tensor", "spans")


def tensor_bytes(values: np.ndarray) -> bytes:
    """A (TIMES, BANDS) array as an Arrow tensor message with named axes."""
    out = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(values, np.float32), dim_names=AXES), out)
    return out.getvalue().to_pybytes()


def read_tensor(cell: bytes) -> pa.Tensor:
    return pa.ipc.read_tensor(pa.BufferReader(cell))


def tensor_table(table: pa.Table) -> pa.Table:
    """The column tensor of read_audio's rows as one Arrow array of tensors of fixed shape."""
    kind = pa.fixed_shape_tensor(pa.float32(), (TIMES, BANDS), dim_names=AXES)
    cells = [read_tensor(c).to_numpy().ravel() for c in table["tensor"].to_pylist()]
    values = pa.array(np.concatenate(cells) if cells else np.zeros(0, np.float32), pa.float32())
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(values, TIMES * BANDS))
    return table.set_column(table.schema.get_field_index("tensor"), pa.field("tensor", kind), column)
