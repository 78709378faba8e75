"""Media columns: texts stored as WAV samples, and spectral-peak fingerprints of what is read back.

A text's bytes, padded with zeros to a positive multiple of 64, become the frames of a mono 8-bit WAV file. The stored
file is parsed again by the wave module. Its samples go through a short-time Fourier transform; in each frame the peaks
of the log spectrum are kept, and each peak is paired with the next ones in time. A pair is (time, anchor bin, target
bin, time between), packed into a long, in time order.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import batches, byte_text, texts

RATE = 8000
UNIT = 64
#: Samples of a frame, from frame to frame, peaks of a frame, and frames ahead in which a peak finds its partner.
FRAME, HOP, PEAKS, AHEAD = 128, 64, 2, 2
#: Samples that AHEAD + 1 frames take, and the hop for fewer.
LEAST, SHORT_HOP = FRAME + AHEAD * HOP, 8
#: Frames transformed at a time, which bounds memory for long texts.
SLICE = 8192
WINDOW = np.hanning(FRAME).astype(np.float32)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pairs", pa.list_(pa.int64()))])
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pairs array<long>"


def to_wav(data: bytes) -> bytes:
    """A mono 8-bit WAV file with one sample a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data + bytes(-len(data) % UNIT or (0 if data else UNIT)))
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit file")
        return w.readframes(w.getnframes())


def peak_bins(samples: np.ndarray) -> np.ndarray:
    """The strongest local maxima of each frame's magnitude spectrum, as (frames, PEAKS) bins, -1 where there is none.

    Ties go to the lower bin. Samples shorter than AHEAD + 1 frames are set between silence and
    taken at a shorter hop, so that short ones have many frames and pairs of their own.
    """
    x = samples.astype(np.float32) - 128
    hop = HOP
    if len(x) < LEAST:
        x, hop = np.pad(x, FRAME), SHORT_HOP
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::hop]
    found = []
    for a in range(0, len(frames), SLICE):
        power = np.abs(np.fft.rfft(frames[a : a + SLICE] * WINDOW, axis=1)).astype(np.float32)
        mid = power[:, 1:-1]
        mid = np.where((mid > power[:, :-2]) & (mid >= power[:, 2:]), np.round(mid, 2), 0)
        rows, best = np.arange(len(mid)), []
        for _ in range(PEAKS):
            top = mid.argmax(axis=1)
            best.append(np.where(mid[rows, top] > 0, top + 1, -1))
            mid[rows, top] = 0
        found.append(np.stack(best, axis=1))
    return np.concatenate(found)


def peak_pairs(bins: np.ndarray) -> np.ndarray:
    """Each peak with each peak of the next AHEAD frames, packed as time << 18 | anchor << 11 | target << 4 | between."""
    made = []
    for gap in range(1, min(AHEAD, len(bins) - 1) + 1):
        times = np.arange(len(bins) - gap, dtype=np.int64)
        for p in range(bins.shape[1]):
            for q in range(bins.shape[1]):
                a, b = bins[:-gap, p], bins[gap:, q]
                ok = (a >= 0) & (b >= 0)
                made.append(times[ok] << 18 | a[ok].astype(np.int64) << 11 | b[ok].astype(np.int64) << 4 | gap)
    return np.sort(np.concatenate(made)) if made else np.empty(0, np.int64)


def features(media: bytes) -> tuple[bytes, np.ndarray]:
    """The payload that a stored file holds and its peak pairs."""
    payload = from_wav(media)
    return payload, peak_pairs(peak_bins(np.frombuffer(payload, np.uint8)))


def one_batch(batch: pa.RecordBatch) -> dict:
    columns: dict[str, list] = {name: [] for name in SCHEMA.names}
    columns["doc_id"] = batch.column("doc_id")
    for text in byte_text(batch.column("text")):
        media = to_wav(text)
        payload, pairs = features(media)
        digest = hashlib.sha256(pairs.tobytes()).hexdigest()
        for name, value in (("n_bytes", len(text)), ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-UNIT:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("feature", digest), ("pairs", pairs)):
            columns[name].append(value)
    return columns


def wav_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (SHA-256 of the pairs) and pairs (time-coded, ascending).

    Null and empty texts give 64 zero bytes. Equal texts give equal values. Long texts are transformed in slices of
    frames. Narrow: nothing is shuffled.
    """
    return texts(docs).mapInArrow(batches(one_batch, SCHEMA), RESULT)


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, the WAV file itself, for those who keep the column."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
    return texts(docs).mapInArrow(batches(lambda b: {"doc_id": b.column("doc_id"), "media": [to_wav(t) for t in byte_text(b.column("text"))]}, schema), "doc_id long, media binary")
