import io
import wave
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm.media import BIN_REACH, FAN_BINS, FAR, FLOOR_DB, NEAR, TIME_REACH, clips, fingerprint, open_wav, peaks, prints, read_wav, spectrogram, wav_prints, write_wav


def tune(seed, seconds=2, rate=8000, decay=0):
    rng, t = np.random.default_rng(seed), np.arange(rate // 4) / rate
    return np.concatenate([np.exp(-decay * t) * sum(0.3 * np.sin(2 * np.pi * f * t) for f in rng.uniform(200, 3500, 3)) for _ in range(seconds * 4)])


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("channels", [1, 2])
def test_samples_round_trip(width, channels):
    x, out = np.linspace(-0.9, 0.9, 500), io.BytesIO()
    full = 2 ** (8 * width - 1)
    v = np.repeat(np.round(x * (full - 1)).astype(np.int64) + (128 if width == 1 else 0), channels)
    raw = b"".join(int(i).to_bytes(width, "little", signed=width > 1) for i in v)
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(11025), w.writeframes(raw)
    y, rate, n = read_wav(out.getvalue())
    assert (rate, n) == (11025, channels) and np.abs(x - y).max() < 2 / full + 1e-6


def test_spectrogram_of_a_tone():
    s = spectrogram(np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000))
    assert s.shape == (31, 257) and (s[:-1].argmax(1) == 64).all() and abs(s[5, 64]) < 0.5


def test_peaks_and_pairs_against_brute_force():
    s = spectrogram(tune(1))
    t, f = peaks(s)
    expected = []
    for i in range(s.shape[0]):
        for j in range(s.shape[1]):
            around = s[max(0, i - TIME_REACH) : i + TIME_REACH + 1, max(0, j - BIN_REACH) : j + BIN_REACH + 1]
            if s[i, j] > FLOOR_DB and s[i, j] == around.max():
                expected.append((i, j))
    assert list(zip(t.tolist(), f.tolist())) == expected
    pairs = sorted((a << 32) | (b << 20) | (d << 8) | (c - a) for a, b in expected for c, d in expected if NEAR <= c - a <= FAR and abs(d - b) <= FAN_BINS)
    assert prints(s).tolist() == pairs and len(pairs) > 50


@pytest.mark.parametrize("samples", [3, 512, 513, 8000, 25_999])
def test_blocks_do_not_show(samples):
    blob = write_wav(tune(7, 4, decay=4)[:samples])
    s = spectrogram(read_wav(blob)[0])
    for block in (1, 5, 16, 4096):
        n, got = wav_prints(*open_wav(blob), block)
        assert n == len(s) and got.tolist() == prints(s).tolist()


def test_samples_of_64_bits_are_bad(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0" * 64)
    blob = bytearray(out.getvalue())
    blob[34:36] = (64).to_bytes(2, "little")
    rows = [(1, bytes(blob)), (2, write_wav(tune(4)) [: 44 + 700])]
    got = {r.clip_id: r for r in fingerprint(spark.createDataFrame(rows, "clip_id long, wav binary")).collect()}
    assert got[1].status == "bad" and got[2].status == "ok" and got[2].n_frames == 1


def shifts(a, b):
    """How often each shift in time is seen among pairs of equal prints."""
    known = defaultdict(list)
    for x in a.tolist():
        known[x & 0xFFFFFFFF].append(x >> 32)
    return Counter(t - (x >> 32) for x in b.tolist() for t in known[x & 0xFFFFFFFF])


@pytest.mark.parametrize("decay, noise", [(0, 0), (4, 0), (4, 0.01)])  # a steady tone has no peak in time that noise leaves alone
def test_an_excerpt_is_found_at_its_offset(decay, noise):
    whole, other = tune(2, 6, decay=decay), tune(3, 6, decay=decay)
    part = whole[256 * 40 : 256 * 100] + np.random.default_rng(0).normal(0, noise, 256 * 60)
    a, b, c = (prints(spectrogram(x)) for x in (whole, part, other))
    found = shifts(a, b)
    assert found[40] > 30 and found[40] > 0.9 * found.total() and shifts(a, c).total() < 0.1 * found[40]


def test_awkward_rows(spark):
    good = write_wav(tune(4))
    rows = [(1, good), (2, good), (3, None), (4, b""), (5, b"RIFF nonsense"), (6, write_wav(np.zeros(0))), (7, write_wav(np.zeros(3))), (None, good), (8, good[:-3]), (9, write_wav(tune(5, 60))), (1, good)]
    media = spark.createDataFrame(rows, "clip_id long, wav binary").selectExpr("*", "1 as prints", "'x' as status")
    got = fingerprint(media).collect()
    by = {r.clip_id: r for r in got}
    assert len(got) == len(rows) and by[1].prints == by[2].prints == by[None].prints and by[1].prints
    assert [by[i].status for i in (1, 3, 4, 5, 6, 7)] == ["ok", "null", "bad", "bad", "empty", "ok"]
    assert by[7].prints == [] and len(by[9].prints) > len(by[1].prints) and by[1].sample_rate == 8000
    assert fingerprint(media.limit(0)).count() == 0


def test_clips_of_a_vector_table(spark):
    e = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [0.5, None]), (4, [])], "vec_id long, embedding array<float>")
    got = {r.clip_id: r for r in fingerprint(clips(e)).collect()}
    assert got[1].status == got[3].status == "ok" and got[2].status == "null" and got[1].n_frames == 31


def test_every_component_of_a_long_vector_sounds(spark):
    rows = [(0, [0.1] * 70), (1, [0.1] * 66 + [0.3] + [0.1] * 3), (2, [0.1] * 69 + [-0.2]), (3, [0.1] * 64), (4, [0.1] * 64 + [0.0] * 6), (5, [0.1] * 300), (6, [0.1] * 299 + [0.4])]
    got = {r.clip_id: bytes(r.wav) for r in clips(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len({got[i] for i in (0, 1, 2)}) == 3 and got[3] == got[4] and got[5] != got[6]
