import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import media as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_wav_holds_the_bytes(data):
    payload = M.from_wav(M.to_wav(data))
    assert payload.startswith(data) and set(payload[len(data) :]) <= {0} and len(payload) % 64 == 0 and len(payload) >= 64 and len(payload) - len(data) <= 64


def slow_pairs(bins):
    found = []
    for t in range(len(bins)):
        for gap in range(1, M.AHEAD + 1):
            if t + gap < len(bins):
                found += [int(t) << 18 | int(a) << 11 | int(b) << 4 | gap for a in bins[t] if a >= 0 for b in bins[t + gap] if b >= 0]
    return sorted(found)


def slow_bins(samples):
    x = samples.astype(np.float32) - 128
    x = np.pad(x, (0, max(0, M.FRAME - len(x))))
    out = []
    for a in range(0, len(x) - M.FRAME + 1, M.HOP):
        power = np.abs(np.fft.rfft(x[a : a + M.FRAME] * M.WINDOW)).astype(np.float32)
        peaks = [(-round(float(power[k]), 2), k) for k in range(1, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1] and round(float(power[k]), 2) > 0]
        best = [k for _, k in sorted(peaks)[: M.PEAKS]]
        out.append(best + [-1] * (M.PEAKS - len(best)))
    return np.array(out)


def test_fingerprints_equal_slow_ones(monkeypatch):
    monkeypatch.setattr(M, "SLICE", 7)
    tone = np.round(128 + 60 * np.sin(np.arange(3000) * 0.3) + 30 * np.sin(np.arange(3000) * 1.1)).astype(np.uint8)
    bins = M.peak_bins(tone)
    assert (np.sort(bins) == np.sort(slow_bins(tone))).mean() > 0.99
    assert M.peak_pairs(bins).tolist() == slow_pairs(bins)
    # a tone of 0.3 radians a sample peaks at its own bin
    assert (bins[:, 0] == round(0.3 * M.FRAME / (2 * np.pi))).mean() > 0.95


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "text " * 100), (4, "text " * 100), (None, "ü" * 40_000), (1, "a")]
    got = M.wav_fingerprints(spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, feature string")).collect()
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert len(got) == 6 and by[1, 0].feature == by[2, 0].feature and by[1, 0].payload_bytes == 64
    assert by[3, 500][1:] == by[4, 500][1:]
    text = ("ü" * 40_000).encode()
    r = by[None, 80_000]
    assert r.payload_sha256 == hashlib.sha256(text).hexdigest() and r.tail_crc32 == zlib.crc32(text[-64:]) and r.media_bytes == 80_000 + 44
    assert list(r.pairs) == sorted(r.pairs)
    assert M.wav_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert {r.doc_id for r in M.stored_media(spark.createDataFrame([(5, "x")], "doc_id long, text string")).collect()} == {5}


def test_short_texts_have_pairs_of_their_own():
    short = [b"a", b"one two", b"three four", b"Short text.", b"x" * 65, b"some words of a line that is between one and two units long, here", b"q" * 128]
    pairs = [tuple(M.features(M.to_wav(t))[1].tolist()) for t in short]
    assert all(pairs) and len(set(pairs)) == len(short)


def test_query_features_equal_slow_ones(spark):
    """The digest of a row is that of pairs worked out slowly from the stored samples, for texts on both sides of a slice."""
    rng = np.random.default_rng(2)
    texts = ["", "a", "x" * 128, "words of a text " * 40, "".join(map(chr, rng.integers(32, 127, 5000))), "ü" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same = 0
    for r in M.wav_fingerprints(df).collect():
        payload = texts[r.doc_id].encode()
        payload += bytes(-len(payload) % 64 or (0 if payload else 64))
        x = np.frombuffer(payload, np.uint8)
        if len(x) < M.LEAST:
            bins = M.peak_bins(x)
        else:
            bins = slow_bins(x)
        pairs = slow_pairs(bins)
        assert r.feature == hashlib.sha256(np.array(list(r.pairs), np.int64).tobytes()).hexdigest()
        # rounding of equal peaks may differ in the last place
        common = len(set(pairs) & set(r.pairs))
        assert common >= 0.99 * max(len(pairs), len(r.pairs))
        same += pairs == list(r.pairs)
    assert same >= len(texts) - 1
