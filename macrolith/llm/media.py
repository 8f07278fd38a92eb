"""Media columns: WAV bytes in a table, spectra, and spectral-peak pair fingerprints.

``to_wav`` stores payloads as 8-bit mono WAV in a binary column; ``describe``
reads such a column with the wave module, takes short-time Fourier transforms
(``FRAME`` samples, Hann window, ``HOP`` apart), keeps in each frame the ``PEAKS``
strongest local maxima of the magnitude, and pairs each with those of the next
``SPAN`` frames' first peak. A pair is the code f1 << 15 | f2 << 6 | frames apart; codes
go with their frame as two arrays, times and codes, which ``feature`` sums up.

Edge cases: a null or empty text is one block of zero bytes; a payload shorter
than a frame, or whose last frame is not full, is padded with silence for the transform only; silence has no
peaks; equal payloads have equal results; long ones are transformed in blocks.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, only, stored

UNIT, RATE = 64, 8000
FRAME, HOP, PEAKS, SPAN = 256, 128, 2, 3
_HANN = np.hanning(FRAME).astype(np.float32)


def payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the UTF-8 padded with zero bytes to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def write_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames by PEAKS: bins of the strongest local maxima (0: none), and their magnitudes."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    if short := FRAME - len(x) if len(x) < FRAME else (FRAME - len(x)) % HOP:
        x = np.concatenate((x, np.zeros(short, np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, size = [], []
    for at in range(0, len(frames), 2048):
        part = frames[at : at + 2048]
        s = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * _HANN, axis=1)).astype(np.float32)
        mid = s[:, 1:-1]
        top = np.where((mid > s[:, :-2]) & (mid >= s[:, 2:]) & (mid > 1e-3), mid, 0)
        k = np.argpartition(-top, PEAKS, axis=1)[:, :PEAKS]
        v = np.take_along_axis(top, k, 1)
        order = np.lexsort((k, -v), axis=1)
        k, v = np.take_along_axis(k, order, 1), np.take_along_axis(v, order, 1)
        bins.append(np.where(v > 0, k + 1, 0))
        size.append(v)
    return np.concatenate(bins), np.concatenate(size)


def pairs(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """times, codes: of each peak with the first peak of the next SPAN frames, in order of time and code."""
    times, codes = [], []
    n = len(bins)
    for d in range(1, SPAN + 1):
        if n > d:
            a, b = bins[:-d], bins[d:, :1]
            t, c = np.broadcast_to(np.arange(n - d)[:, None], a.shape), a << 15 | b << 6 | d
            ok = (a > 0) & (b > 0)
            times.append(t[ok])
            codes.append(c[ok])
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def to_wav(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary)."""
    rows = only(docs, doc_id, text).toDF("doc_id", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [payload(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in p], pa.int64()), pa.array([write_wav(x[1]) for x in p], pa.binary())], ["doc_id", "n_bytes", "media"])

    return by_batch(rows, go, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Per row of doc_id, n_bytes, media: digests of what is read back, and the fingerprint arrays times and codes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for m in b.column(2).to_pylist():
                raw = read_wav(m)
                t, c = pairs(peaks(raw)[0])
                for to, v in zip(out, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), t, c), strict=True):
                    to.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", *_NAMES])

    return by_batch(media, go, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>")


_NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes")


def media_features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the media table to the shared folder, reads it back and describes it."""
    spark = docs.sparkSession
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    try:
        kept = stored(to_wav(docs, doc_id=doc_id, text=text), "media")
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", codec)
    found = describe(kept)
    return found.withColumn("feature", F.concat(F.size("codes").cast("string"), F.lit(":"), F.sha2(F.concat_ws(";", F.concat_ws(",", F.col("times").cast("array<string>")), F.concat_ws(",", F.col("codes").cast("array<string>"))), 256)))
