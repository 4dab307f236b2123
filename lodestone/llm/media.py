"""9. Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, HOP, RATE = 512, 256, 8000
TIME_REACH, BIN_REACH = 3, 12  # half sizes of the neighbourhood in which a peak is the largest
NEAR, FAR, FAN_BINS = 1, 16, 96  # a pair's second peak follows within these frames and bins
FLOOR_DB = -60.0
BLOCK, ROWS = 4096, 256  # frames in memory at once; clips to a batch of results
SCHEMA = "clip_id long, status string, sample_rate int, channels int, n_frames int, prints array<long>"


def _samples(w: wave.Wave_read, start: int, n: int) -> np.ndarray:
    """Mono samples in [-1, 1] from ``start`` on; fewer at the end."""
    channels, width = w.getnchannels(), w.getsampwidth()
    w.setpos(start)
    raw = w.readframes(n)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 2**15
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2**31
    return x.reshape(-1, channels).mean(1)


def open_wav(blob: bytes) -> tuple[wave.Wave_read, int]:
    """Reader of PCM of 8, 16, 24 or 32 bits, and the samples that are there, whatever the header says."""
    w = wave.open(io.BytesIO(blob))
    if w.getsampwidth() not in (1, 2, 3, 4):
        raise wave.Error(f"samples of {w.getsampwidth()} bytes")
    there, size = 0, w.getnchannels() * w.getsampwidth()
    while got := len(w.readframes(1 << 18)) // size:
        there += got
    return w, min(there, w.getnframes())


def read_wav(blob: bytes) -> tuple[np.ndarray, int, int]:
    """All mono samples, rate and channels."""
    w, n = open_wav(blob)
    return _samples(w, 0, n), w.getframerate(), w.getnchannels()


def write_wav(x: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def spectrogram(x: np.ndarray) -> np.ndarray:
    """Level in dB (frames x bins), Hann windows of 512 samples every 256; the last one is padded."""
    n = max(1, -(-max(0, len(x) - WINDOW) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP] * np.hanning(WINDOW).astype(np.float32)
    return 20 * np.log10(np.abs(np.fft.rfft(frames, axis=1)) / (WINDOW / 4) + 1e-9)


def _highest(a: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Running maximum over 2 * reach + 1 neighbours, by doubling."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    a, have, want = np.pad(a, pad, constant_values=-np.inf), 1, 2 * reach + 1
    while have < want:
        step = min(have, want - have)
        a = np.maximum(a[:-step], a[step:]) if axis == 0 else np.maximum(a[:, :-step], a[:, step:])
        have += step
    return a


def peaks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of local maxima above the floor, in order of time."""
    return np.nonzero((s == _highest(_highest(s, TIME_REACH, 0), BIN_REACH, 1)) & (s > FLOOR_DB))


def paired(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """A 64-bit value for each pair of peaks: frame of the first << 32 | its bin << 20 | the other's bin << 8 | frames
    between. The low 32 bits identify the sound, the high ones tell when it was heard."""
    out = []
    for step in range(1, len(t)):
        dt, df = t[step:] - t[:-step], np.abs(f[step:] - f[:-step])
        if not (dt <= FAR).any():
            break
        ok = (dt >= NEAR) & (dt <= FAR) & (df <= FAN_BINS)
        a, b = np.flatnonzero(ok), np.flatnonzero(ok) + step
        out.append((t[a].astype(np.int64) << 32) | (f[a].astype(np.int64) << 20) | (f[b].astype(np.int64) << 8) | (t[b] - t[a]))
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def prints(s: np.ndarray) -> np.ndarray:
    return paired(*peaks(s))


def wav_prints(w: wave.Wave_read, n: int, block: int = BLOCK) -> tuple[int, np.ndarray]:
    """Frames and fingerprints of ``n`` samples, a block of frames at a time: neighbouring blocks overlap by the reach of
    a peak, so the blocks don't show in the result, and memory holds one block and the peaks."""
    frames = max(1, -(-max(0, n - WINDOW) // HOP) + 1)
    times, bins = [], []
    for lo in range(0, frames, block):
        hi = min(frames, lo + block)
        a, b = max(0, lo - TIME_REACH), min(frames, hi + TIME_REACH)
        s = spectrogram(_samples(w, a * HOP, min(n, (b - 1) * HOP + WINDOW) - a * HOP))[: b - a]
        t, f = peaks(s)
        own = (t + a >= lo) & (t + a < hi)
        times.append(t[own] + a)
        bins.append(f[own])
    return frames, paired(np.concatenate(times), np.concatenate(bins))


def _fingerprint(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield _rows(batch.slice(start, ROWS))


def _rows(batch):
    status, rate, channels, n, codes = [], [], [], [], []
    for blob in batch.column("wav"):
        told, r, c, frames, own = "null", None, None, 0, np.zeros(0, np.int64)
        if blob.is_valid:
            try:
                w, samples = open_wav(blob.as_py())
                told, r, c = ("ok" if samples else "empty"), w.getframerate(), w.getnchannels()
                if samples:
                    frames, own = wav_prints(w, samples)
            except (wave.Error, EOFError, ValueError, ZeroDivisionError):
                told, r, c = "bad", None, None
        status.append(told)
        rate.append(r)
        channels.append(c)
        n.append(frames)
        codes.append(own)
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column("clip_id"), pa.array(status, pa.string()), pa.array(rate, pa.int32()), pa.array(channels, pa.int32()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int64)))],
        names=["clip_id", "status", "sample_rate", "channels", "n_frames", "prints"],
    )


def fingerprint(media: DataFrame, id_col: str = "clip_id", wav_col: str = "wav") -> DataFrame:
    """(clip_id, status, sample_rate, channels, n_frames, prints) for each row with a WAV column.

    ``prints`` is sorted (see :func:`paired`). Status "null" for a null column, "bad" for bytes that are no PCM WAV of 8
    to 32 bits, "empty" for one without samples: those have no prints. A clip shorter than its header says counts as
    far as it goes. Equal clips have equal prints. Repeated rows give a row
    each, a null id stays null, extra columns are ignored, an empty table gives no rows. Clips may be of any length:
    beside the column's bytes, a task holds one block of frames and the peaks.
    """
    return media.select(F.col(id_col).cast("long").alias("clip_id"), F.col(wav_col).alias("wav")).mapInArrow(_fingerprint, SCHEMA)


def _partials(n):
    """A tone for each of n components, 50 Hz apart or as close as fits below half the sample rate."""
    t = np.arange(RATE, dtype=np.float32) / RATE
    partials = np.sin(2 * np.pi * (100 + min(50, (RATE / 2 - 200) / n) * np.arange(n, dtype=np.float32))[:, None] * t)
    slots = np.arange(RATE) * 16 // RATE  # every sixteenth of a second another sixteenth of the partials sounds
    partials *= (np.arange(n)[:, None] % 16 == slots).astype(np.float32)
    return partials


def _render(batches):
    partials = _partials(64)
    for batch in batches:
        vectors, wavs = batch.column("embedding").to_pylist(), []
        for v in vectors:
            if v is not None and max(64, len(v)) != len(partials):
                partials = _partials(max(64, len(v)))
            wavs.append(None if v is None else write_wav(np.asarray([0 if y is None else y for y in v] + [0] * (len(partials) - len(v)), np.float32) @ partials))
        yield pa.RecordBatch.from_arrays([batch.column("clip_id"), pa.array(wavs, pa.binary())], names=["clip_id", "wav"])


def clips(embeddings: DataFrame) -> DataFrame:
    """A clip of one second for each row of a vector table, for tables that come without sound: each component is the
    amplitude of a tone. (clip_id, wav)"""
    return embeddings.select(F.col("vec_id").cast("long").alias("clip_id"), "embedding").mapInArrow(_render, "clip_id long, wav binary")
