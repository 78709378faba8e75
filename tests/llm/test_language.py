import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import language as G


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = G.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_counts_and_posteriors_equal_plain_ones(spark):
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the end", "en"), ("12 34", "xx")]
    langs, prior, table = G.fit(spark.createDataFrame(rows, "text string, label string").repartition(3))
    counts = {k: Counter() for k in ("en", "fr")}
    for t, k in rows[:3]:
        counts[k].update(G.ngrams(G.letters(t)).tolist())
    assert langs == ["en", "fr"] and np.allclose(prior, np.log([2 / 3, 1 / 3]))
    for i, k in enumerate(langs):
        total = sum(counts[k].values()) + G.SMOOTHING * G.BUCKETS
        want = np.log([(counts[k][b] + G.SMOOTHING) / total for b in range(200)])
        assert np.allclose(table[i, :200], want)


def test_defined_results(spark):
    model = (["a", "b"], np.log([0.5, 0.5]), np.full((2, G.BUCKETS), -10.0))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "word"), (None, "w" * 2_000_000), (4, "word")]
    got = G.predict(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double"), model).collect()
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 3)) for r in got) == [("1", "und", 0), ("2", "und", 0), ("3", "und", 0), ("4", "a", 0.5), ("4", "a", 0.5), ("None", "a", 0.5)]
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in G.identify(unlabelled).collect()] == ["und"]
    assert G.identify(unlabelled.filter("false")).count() == 0


def plain_letters(text):
    import re

    return " " + re.sub(r"[^a-zäöüéè]+", " ", text.lower()).strip() + " "


def test_slices_lose_no_ngrams(monkeypatch):
    text = G.letters("".join("abcdefghij klmnopq"[i * 7 % 18] for i in range(500)))
    want = Counter(G.ngrams(text).tolist())
    assert sum(want.values()) == 3 * len(text) - 3
    for size in (1, 2, 3, 5, 64, 499):
        monkeypatch.setattr(G, "SLICE", size)
        assert Counter(np.concatenate(list(G.sliced_ngrams(text))).tolist()) == want


def test_posteriors_equal_plain_sums(spark):
    """log prior plus each n-gram's log probability, one at a time, for texts of mixed languages and over a slice."""
    train = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), ("the end", "en")]
    model = langs, prior, table = G.fit(spark.createDataFrame(train, "text string, label string"))
    words = " ".join(t for t, _ in train).split()
    rows = [(i, " ".join(words[(i * 5 + k * k) % len(words)] for k in range(1 + i % 9))) for i in range(200)] + [(1000, "le chat and der hund " * 30_000)]
    assert len(rows[-1][1]) > 2 * G.SLICE
    got = {r.doc_id: r for r in G.predict(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        # as the matrix that is sent is of float32
        sums = prior + sum(n * table[:, b].astype(np.float32).astype(float) for b, n in Counter(G.ngrams(plain_letters(text)).tolist()).items())
        share = np.exp(sums - sums.max())
        assert got[i].lang_pred == langs[int(sums.argmax())] and abs(got[i].score - 1 / share.sum()) < 1e-6


def test_too_many_languages_are_refused(spark):
    df = spark.range(G.MOST_LANGUAGES + 1).selectExpr("'text' as text", "concat('l', id) as label")
    with pytest.raises(ValueError):
        G.fit(df)


def test_sums_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(G.BUCKETS, 3)).astype(np.float32)
    rows = [(i % 7, rng.integers(0, G.BUCKETS, n)) for i, n in enumerate((5, 0, 400, 1, 30, 90, 2000, 7, 7))]
    want = np.zeros((7, 3))
    for i, found in rows:
        for f in found:
            want[i] += table[f]
    for cells in (1, 100, G.CELLS):
        monkeypatch.setattr(G, "CELLS", cells)
        total = np.zeros((7, 3))
        G.add_scores(total, rows, table)
        assert np.allclose(total, want)
