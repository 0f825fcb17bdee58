"""Media columns: bytes as WAV samples, spectra, and fingerprints of pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, tidied

BLOCK = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Frames that are transformed at once; memory is bounded by it whatever a recording's length.
FRAMES_AT_ONCE = 4096
#: First bins of the bands that give one peak each (fixed values), and the frames a pair may span.
BANDS = (1, 12, 40)
REACH = 3


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


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


def peaks(samples: np.ndarray) -> np.ndarray:
    """frames x bands: the loudest bin of each band in each frame of the short-time Fourier transform."""
    count = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((count, len(BANDS)), np.int64)
    edges = (*BANDS, FRAME // 2 + 1)
    for first in range(0, count, FRAMES_AT_ONCE):
        n = min(FRAMES_AT_ONCE, count - first)
        own = samples[first * HOP : (first + n - 1) * HOP + FRAME].astype(np.float32) - 128
        own = np.pad(own, (0, (n - 1) * HOP + FRAME - len(own)))
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(own, FRAME)[::HOP] * window, axis=1)
        # whole numbers, so that equal sounds give equal peaks on any machine
        loud = np.rint(spectrum.real**2 + spectrum.imag**2)
        for band, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            out[first : first + n, band] = low + loud[:, low:high].argmax(axis=1)
    return out


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs, in time order: frame << 24 | bin << 16 | later bin << 8 | frames between."""
    top = peaks(samples)
    at, found = np.arange(len(top), dtype=np.int64), []
    for gap in range(1, REACH + 1):
        if len(top) > gap:
            for band in range(len(BANDS)):
                later = (band + gap) % len(BANDS)
                found.append(at[:-gap] << 24 | top[:-gap, band] << 16 | top[gap:, later] << 8 | gap)
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    and ``media`` (binary WAV) and ``fingerprint`` (array<long>) if ``with_media``.

    Null and empty texts give 64 zero bytes.  A text shorter than a frame is padded with silence and
    has no pairs.  Rows are independent: repeated rows give equal values, identifiers may be null,
    other columns are ignored and an empty table gives an empty result.
    """
    plain = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    real = [("media", T.BinaryType()), ("fingerprint", T.ArrayType(T.LongType()))] if with_media else []
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(*x) for x in plain + real]])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())]

    def one(text: str | None) -> tuple:
        data = (text or "").encode()
        media = to_wav(padded(data))
        stored = from_wav(media)
        pairs = fingerprints(np.frombuffer(stored, np.uint8))
        feature = f"{len(pairs)}:{hashlib.sha1(pairs.astype('<i8').tobytes()).hexdigest()}"
        row = (len(data), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        return (*row, media, pairs) if with_media else row

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 256 if with_media else 1 << 20
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                rows = [one(value.as_py()) for value in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], kinds[i]) for i in range(len(schema) - 1)]], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidied(run), schema)


def op5_media(spark, sf_dir):
    return media_columns(documents(spark, sf_dir))
