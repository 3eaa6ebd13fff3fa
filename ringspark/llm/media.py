"""Media columns: payloads kept losslessly as WAV and fingerprinted by spectral peaks.

``encode`` writes bytes as mono 8-bit PCM with the ``wave`` module; ``decode`` reads
the samples back.  ``fingerprint`` takes a Hann-windowed short-time Fourier transform
(frames of 576 samples, hop 288), keeps each frame's strongest bin in each of four
bands where it also exceeds the frames beside it, and pairs every peak with those of
the frames 1 to 3 after it.  A pair is one long: time of the first peak << 32 |
first bin << 20 | second bin << 8 | distance in frames, sorted, so the array is coded by time.

The array is a column of the result; ``feature`` names it by its length and SHA-256.

Memory: one payload and blocks of 2048 frames. Defined results: null and empty texts
give one unit of 576 bytes 255 and no pairs; equal payloads give equal values, so repeated rows
are alike; of equally strong bins the lowest is the peak; an empty table gives an empty result.
Callers' columns with the names of results are kept under the next free names (``media_1``).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, make_room

UNIT = 576
HOP = 288
RATE = 8000
BANDS = ((2, 20), (20, 60), (60, 130), (130, 288))
AHEAD = 3
FRAMES = 2048


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def encode(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """Frames x bands: the bin of the peak, or 0."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    window = np.hanning(UNIT).astype(np.float32)
    best, power = [], []
    for at in range(0, len(frames), FRAMES):
        part = frames[at : at + FRAMES].astype(np.float32) - np.float32(128)
        part -= part.mean(1, keepdims=True)
        spectrum = np.abs(np.fft.rfft(part * window, axis=1))
        tops = [spectrum[:, a:b].argmax(1) + a for a, b in BANDS]
        best.append(np.column_stack(tops))
        power.append(np.column_stack([spectrum[np.arange(len(part)), t] for t in tops]))
    bins, strength = np.concatenate(best), np.concatenate(power)
    before = np.vstack([np.zeros((1, len(BANDS))), strength[:-1]])
    after = np.vstack([strength[1:], np.zeros((1, len(BANDS)))])
    return np.where((strength > before) & (strength >= after) & (strength > 1e-3), bins, 0).astype(np.int64)


def fingerprint(data: bytes) -> np.ndarray:
    found = peaks(np.frombuffer(data, np.uint8))
    pairs = []
    for gap in range(1, AHEAD + 1):
        if len(found) <= gap:
            break
        first, second = found[:-gap], found[gap:]
        for a in range(len(BANDS)):
            for b in range(len(BANDS)):
                at = np.flatnonzero((first[:, a] > 0) & (second[:, b] > 0))
                pairs.append(at << 32 | first[at, a] << 20 | second[at, b] << 8 | gap)
    return np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)


def media(text: Column) -> Column:
    """The WAV bytes of a text's payload."""

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(payload(x)) for x in texts])

    return stored(text)


def features(stored: Column) -> Column:
    """What the stored bytes say once read back, with the pairs' array and its name."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pairs array<long>")
    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            data = decode(x)
            pairs = fingerprint(data)
            name = f"{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()[:32]}"
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(x), hashlib.sha256(x).hexdigest(), name, pairs))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pairs"])

    return read(stored)


def to_media(docs: DataFrame, text_col: str = "text", out: str = "media", features_out: str = "features") -> DataFrame:
    """docs with the columns media (WAV bytes) and features (struct with the pairs)."""
    docs = make_room(docs, out, features_out)
    return docs.withColumn(out, media(F.col(text_col))).withColumn(features_out, features(F.col(out)))


def query(spark, sf_dir: str) -> DataFrame:
    out = to_media(documents(spark, sf_dir).select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), "features.*")
