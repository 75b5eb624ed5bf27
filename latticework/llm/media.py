"""Media columns (operator 3): WAV payloads and their spectral fingerprints.

A payload of bytes is stored as 8-bit mono PCM in a WAV file, which holds it bit
for bit, and is read back with the ``wave`` module.  Its short-time Fourier
transform (frames of 512 samples, 256 apart, Hann window) yields for each of four
frequency bands the strongest bin of each frame; it is a peak if it isn't below
the same bin one frame before and is above that one frame after.  Each peak is
paired with the next ``FAN`` peaks at most ``REACH`` frames away, and the pair
(bin, bin, frames between) with its frame number makes one 64-bit fingerprint.
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

from latticework.llm.common import picked, raw_texts, slices

UNIT, RATE = 64, 16_000
FRAME, HOP, FAN, REACH = 512, 256, 2, 63
BANDS = ((1, 16), (16, 64), (64, 128), (128, 257))
_WINDOW = np.hanning(FRAME).astype(np.float32)
_CHUNK = 2048  # frames transformed at once


def payload_of(raw: bytes | None) -> bytes:
    """The bytes with zeros appended up to a positive multiple of 64; null counts as empty."""
    raw = raw or b""
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _strongest(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Spectral magnitudes of ``count`` frames from frame ``first``; frames outside are silent."""
    lo, hi = first * HOP, (first + count - 1) * HOP + FRAME
    part = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(samples))
    if a < b:
        part[a - lo : b - lo] = samples[a:b].astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
    return np.round(np.abs(np.fft.rfft(frames * _WINDOW)), 1)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and bins of the spectral peaks, in order of time, then bin."""
    total = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    times, bins = [], []
    for first in range(0, total, _CHUNK):
        count = min(_CHUNK, total - first)
        level = _strongest(samples, first - 1, count + 2)  # one more frame on either side
        row = np.arange(1, count + 1)
        for lo, hi in BANDS:
            top = level[1:-1, lo:hi].argmax(axis=1) + lo
            here = level[row, top]
            keep = (here > 0) & (here >= level[row - 1, top]) & (here > level[row + 1, top])
            times.append(row[keep] - 1 + first)
            bins.append(top[keep])
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Sorted time-coded pair fingerprints: frame << 24 | bin << 15 | bin << 6 | frames between."""
    t, f = peaks(samples)
    found = []
    for step in range(1, FAN + 1):
        gap = t[step:] - t[:-step]
        near = gap <= REACH
        found.append((t[:-step] << 24 | f[:-step] << 15 | f[step:] << 6 | gap)[near] if len(t) > step else np.empty(0, np.int64))
    return np.sort(np.concatenate(found).astype(np.int64))


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_fingerprints long, feature string, fingerprints array<long>"


def _digests(raw: bytes | None) -> tuple:
    media = write_wav(payload_of(raw))
    stored = read_wav(media)
    prints = fingerprints(np.frombuffer(stored, np.uint8))
    feature = f"{len(prints)}:{hashlib.sha256(prints.astype('<i8').tobytes()).hexdigest()}"
    return media, prints, (len(raw or b""), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(prints), feature)


def _run(with_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most_rows=512):
            found = [_digests(raw) for raw in raw_texts(batch.column("text"))]
            arrays = [batch.column("doc_id"), *(pa.array(x) for x in zip(*(row for _, _, row in found), strict=True))]
            names = [part.split()[0] for part in _SCHEMA.split(", ")]
            ends = np.cumsum([0, *(len(p) for _, p, _ in found)])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([p for _, p, _ in found]), pa.int64())))
            if with_media:
                arrays.append(pa.array([m for m, _, _ in found], pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_media: bool = True) -> DataFrame:
    """One row for each row of ``docs``: digests of payload, stored form and features, and the
    ``fingerprints`` themselves, a time-coded array of long.

    ``with_media`` adds the column ``media`` (the WAV file).  A null text counts as empty and has a payload of 64 zero
    bytes; a null doc_id stays null; equal texts have equal values.  A payload
    that is constant has no peaks and an empty array.  Other columns are ignored.
    """
    own = picked(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    return own.mapInArrow(_run(with_media), _SCHEMA + (", media binary" if with_media else ""))
