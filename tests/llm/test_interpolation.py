import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm import interpolation as I

TEXTS = ["the cat sat on the mat", "The CAT sat", None, "", "a b a b a b", "one\ttwo\nthree", "the the the the", "é É é", "the cat sat on a hat", "x" * 20_000]
ROWS = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(3, "the cat sat"), (None, "the mat")]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def level(n):
    return n.bit_length()


def brute(rows, mix):
    """Scores from plain counts, given the weights."""
    c1, c2 = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = words(t)
            c1.update(w)
            c2.update(zip(["", *w], w, strict=False))
    n, v = sum(c1.values()), len(c1)
    out = []
    for i, t in rows:
        w, score, base = words(t), 0.0, 0.0
        for a, b in zip(["", *w], w, strict=False):
            own = mix[level(c1[a])]
            score += math.log10(own[0] * c2[a, b] / max(c1[a], 1) + own[1] * c1[b] / n + own[2] / (v + 1))
            base += math.log10((c1[b] + 1) / (n + v + 1))
        out.append((i, held(i), len(w), sum(c1[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def brute_histogram(rows):
    """Tokens by level, bigram and unigram probability without themselves."""
    c1, c2, cells = Counter(), Counter(), Counter()
    trained = [words(t) for i, t in rows if not held(i)]
    for w in trained:
        c1.update(w)
        c2.update(zip(["", *w], w, strict=False))
    n = sum(c1.values())
    for w in trained:
        for a, b in zip(["", *w], w, strict=False):
            s1 = 1 + int(8 * math.log2(c1[a] - 1)) if c1[a] > 1 else 0
            p2 = min((c2[a, b] - 1) / 2 ** ((s1 - 0.5) / 8), 1.0) if s1 else 0.0
            steps = [round(8 * math.log2(p)) + I.OFFSET if p > 0 else 0 for p in (p2, (c1[b] - 1) / (n - 1))]
            cells[level(c1[a] - 1) << 2 * I.STEP_BITS | steps[0] << I.STEP_BITS | steps[1]] += 1
    return dict(cells)


@pytest.mark.parametrize("bucket_tokens", [3_000_000, 3])
def test_scores_equal_plain_counts(spark, monkeypatch, bucket_tokens):
    monkeypatch.setattr(I, "BUCKET_TOKENS", bucket_tokens)
    seen = []
    learn = I.expectation_maximisation
    monkeypatch.setattr(I, "expectation_maximisation", lambda *a: seen.append((a, learn(*a))) or seen[-1][1])
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, score int").repartition(5)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in I.interpolated_scores(df).collect()]
    assert sorted(got, key=str) == brute(ROWS, seen[0][1])
    assert dict(zip(seen[0][0][0].tolist(), seen[0][0][1].astype(int).tolist(), strict=True)) == brute_histogram(ROWS)


def test_empty_and_untrained(spark):
    assert I.interpolated_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(100) if held(i))
    row = I.interpolated_scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_weights_are_mixtures_and_prefer_what_predicts():
    histogram = I.code(np.array([3, 0]), I.count_step(np.array([5, 17])), I.step(np.array([0.001, 0.01])))
    mix = I.expectation_maximisation(histogram, np.array([1000.0, 1000.0]), 5000)
    assert np.allclose(mix.sum(axis=1), 1) and mix[3, 0] > 0.9 and mix[5, 1] > 0.9 and mix[0, 0] == 0


def test_levels_are_powers_of_two():
    n = np.array([0, 1, 2, 3, 4, 7, 8, 2**40 - 1, 2**40])
    assert I.level_of(n).tolist() == [level(int(x)) for x in n]
    n = np.arange(5000)
    assert (I.code(n, I.count_step(n), 0 * n) >> 2 * I.STEP_BITS == I.level_of(n)).all()


def test_a_word_of_most_rows_is_one_item_a_slice(spark):
    """A bucket gets each key once from a slice, however often it occurs there."""
    df = spark.range(2000).selectExpr("id as doc_id", "'hot hot hot' as text").repartition(4)
    slices = I.texts(df).withColumn("train", I.F.lit(True)).mapInArrow(I.tokenise, I.TOKENS)
    items = slices.mapInArrow(I.ask_words(2), I.ASKED).collect()
    assert sum(len(I.unpack(r.key, "<u8", True)) for r in items) == 2 * slices.count() <= 16
    assert sum(I.unpack(r.n, "<u4").sum() for r in items) == 8000


@given(st.lists(st.integers(-(2**62), 2**62), max_size=50))
def test_packed_arrays_come_back(values):
    x = np.array(sorted(values), np.int64)
    assert (I.unpack(I.pack(x, True), "<i8", True) == x).all() and (I.unpack(I.pack(x), "<i8") == x).all()
