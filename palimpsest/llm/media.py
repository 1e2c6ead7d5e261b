"""Media columns: bytes kept as WAV sound, read back, and described by pairs of spectral peaks.

`as_wav` turns a text column into a column of WAV files (mono, 8 bits a sample, one byte a sample, so nothing is
lost). `describe_wav` reads such files with the wave module, takes a short-time Fourier transform of each (frames of
128 samples, every 64, less their mean, Hann window), keeps each frame's two strongest peaks, pairs each peak with those of its own and the
next two frames, and returns the pairs with the time of the first peak as an array of time-coded landmarks, time << 32 |
code, in order. `feature` is made from that array: the number of landmarks, a digest of all of them, and a sketch of fixed
length, the smallest hashes of frames' constellations (all codes that begin in one frame): long texts hold nearly every
code somewhere, but not the same frames. Work is row by row: nothing is shuffled, and slices of an Arrow batch are
transformed a bounded number of frames at a time.

Null and empty texts are 64 zero bytes. Texts of any length are taken whole. Equal texts give equal values; repeated
and null document ids are rows of their own. An empty table gives no rows. Other columns are ignored.
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

from .batches import in_slices
from .common import text_of

RATE = 8000
UNIT = 64
HOP, FRAME = 64, 128
PEAKS = 2
REACH = 2
SKETCH = 16
#: Frames that are transformed at once.
CHUNK = 16_384
_WINDOW = np.hanning(FRAME).astype(np.float32)
#: Sampling order of the codes: fixed odd multipliers.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def padded(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * ((-len(data)) % UNIT if data else UNIT)


def wav_bytes(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def wav_payload(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not mono sound of 8 bits")
        return f.readframes(f.getnframes())


def spectral_peaks(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(frames, 2) bins of the strongest spectral peaks of each frame, in order of strength, and each payload's first frame.

    A payload of n samples has ceil(n / 64) frames; the last ones are filled up with silence (128).
    """
    counts = np.array([-(-len(p) // HOP) for p in payloads])
    starts = np.cumsum(counts) - counts
    total = int(counts.sum())
    blocks = np.full((total + 1, HOP), 128, dtype=np.uint8)
    flat, last = blocks.reshape(-1), np.zeros(total, dtype=bool)
    for p, at, n in zip(payloads, starts, counts, strict=True):
        flat[at * HOP : at * HOP + len(p)] = np.frombuffer(p, np.uint8)
        last[at + n - 1 : at + n] = True
    bins = np.empty((total, PEAKS), dtype=np.int64)
    for a in range(0, total, CHUNK):
        b = min(total, a + CHUNK)
        after = blocks[a + 1 : b + 1].copy()
        after[last[a:b]] = 128
        frames = np.hstack([blocks[a:b], after]).astype(np.float32)
        frames -= frames.mean(axis=1, keepdims=True)  # else the mean's leakage into the first bin is the strongest peak of all
        frames *= _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)[:, 1:]).astype(np.float32)
        power = np.round(power * 16)  # equal sounds in other batches must round alike
        peak = power.copy()
        peak[:, 1:][power[:, 1:] < power[:, :-1]] = -1
        peak[:, :-1][power[:, :-1] <= power[:, 1:]] = -1
        for k in range(PEAKS):
            top = peak.argmax(axis=1)
            bins[a:b, k] = top + 1
            peak[np.arange(b - a), top] = -2
    return bins, np.append(starts, total)


def landmarks(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes (first bin, second bin, frames between) of a payload's peak pairs, in order of time."""
    n, times, codes = len(bins), [], []
    for ahead in range(REACH + 1):
        a, b = bins[: n - ahead], bins[ahead:]
        for i in range(PEAKS):
            for j in range(PEAKS):
                if ahead or i < j:
                    codes.append(a[:, i] << 16 | b[:, j] << 8 | ahead)
                    times.append(np.arange(max(0, n - ahead)))
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order], code[order]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _SPREAD
    return (x ^ x >> np.uint64(29)) * _MIX


def sketch(time: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The smallest hashes of the distinct constellations; times must be in order."""
    if not len(time):
        return np.zeros(0, np.uint64)
    starts = np.nonzero(np.append(True, time[1:] != time[:-1]))[0]
    return np.unique(_mixed(np.add.reduceat(_mixed(code.astype(np.uint64)), starts)) >> np.uint64(32))[:SKETCH]


def feature(marks: np.ndarray) -> str:
    """Number, digest and sketch of time-coded landmarks."""
    digest = hashlib.blake2b(marks.astype("<i8").tobytes(), digest_size=8).hexdigest()
    return f"{len(marks)}:{digest}:" + "".join(f"{int(x):08x}" for x in sketch(marks >> 32, marks & 0xFFFFFFFF))


def as_wav(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and wav, the text as a sound file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array([wav_bytes(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "wav"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(in_slices(store, "text"), "doc_id long, n_bytes long, wav binary")


_DESCRIBED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("landmarks", pa.list_(pa.int64()))]
)


def describe_wav(media: DataFrame, with_landmarks: bool = True) -> DataFrame:
    """Read each sound file back: sizes, hashes, feature, and landmarks (unless they aren't asked for), time << 32 | code."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch["wav"].to_pylist()
            payloads = [wav_payload(w) for w in files]
            bins, starts = spectral_peaks(payloads)
            marks = [time << 32 | code for time, code in (landmarks(bins[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True))]
            made = {
                "payload_bytes": [len(p) for p in payloads], "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads], "tail_crc32": [zlib.crc32(p[-UNIT:]) for p in payloads],
                "media_bytes": [len(w) for w in files], "media_sha256": [hashlib.sha256(w).hexdigest() for w in files], "feature": [feature(m) for m in marks],
            }
            ends = np.cumsum([0, *(len(m) for m in marks)]) if with_landmarks else None
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *marks]))) if with_landmarks else pa.nulls(len(files), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(v, _DESCRIBED.field(k).type) for k, v in made.items()), listed], schema=_DESCRIBED)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, landmarks array<long>"
    found = media.mapInArrow(in_slices(describe, "wav"), ddl)
    return found if with_landmarks else found.drop("landmarks")
