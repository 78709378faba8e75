import numpy as np
import pytest

from quern.llm import quality as Q


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_labels(tables):
    docs, labels = tables
    even, odd = Q.grades_of(labels).filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = Q.score(docs.join(odd.select("doc_id"), "doc_id", "left_semi"), Q.fit(docs, even)).join(odd, "doc_id").collect()
    clean = [r.keep for r in got if r.quality == 1 and r.toxic == 0]
    poor = [r.keep for r in got if r.quality == 0]
    toxic = [r.keep for r in got if r.quality == 1 and r.toxic == 1]
    print("kept", np.mean(clean), np.mean(poor), np.mean(toxic))
    assert np.mean(clean) > 0.98 and np.mean(poor) < 0.1 and np.mean(toxic) < 0.5
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_prob <= 1 for r in got)


def test_fit_orders_thresholds_and_separates_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows, index = np.repeat(np.arange(600), 2), np.stack([grades, rng.integers(10, 20, 600)], axis=1).ravel()
    weights, cuts = Q.fit_cumulative(rows, index, np.ones(1200), grades, 3)
    assert cuts[0] <= cuts[1] and weights[0] < weights[1] < weights[2]
    s = weights[grades]
    assert (np.searchsorted(cuts, s) == grades).mean() > 0.95


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (4, "y" * 100_000, 0), (4, "a", 0)], "doc_id long, text string, keep int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.keep for r in Q.classify(docs, none).collect()] == [True] * 5
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, None, 1), (2, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.classify(docs, labels).count() == 5 and Q.classify(docs.filter("false"), labels).count() == 0
    model = Q.fit(docs, Q.grades_of(labels))
    kept, marked = Q.select(docs, model), Q.score(docs, model)
    assert kept.columns == docs.columns and kept.count() == marked.filter("keep").count()


def test_a_repeated_id_is_read_once(spark):
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame([(1, "bad words here"), (2, "good words there")], "doc_id long, text string")
    often = once.unionByName(once.filter("doc_id = 1")).unionByName(spark.createDataFrame([(2, "later text")], "doc_id long, text string"))
    a, b = (Q.fit(d, Q.grades_of(labels)) for d in (once, often))
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_words_share_the_weight_of_their_stem():
    a, b = (set(Q.text_features(t)[0].tolist()) for t in ("walking", "walked"))
    assert len(a & b) >= 2 and Q.bucket(b"p", "walk") in a & b


def test_cache_does_not_change_features():
    text = "Some words, SOME words!! %%% 12 words words"
    a = Q.text_features(text)
    Q._cache.clear()
    b = Q.text_features(text)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def plain_score(text, weights, cuts, levels):
    """Expected grade and tail probability from the definitions, a token at a time."""
    tokens, marks = (text or "").split(), set(Q.MARKS)
    s = 0.0 if tokens else weights[Q.bucket(b"t", "empty")]
    distinct = {}
    for t in tokens:
        a, b = 0, len(t)
        while a < b and t[a] in marks:
            a += 1
        while b > a and t[b - 1] in marks:
            b -= 1
        word, low = t[a:b], t[a:b].lower()
        if not word:
            a = 0
        case = "9" if word.isdigit() else "A" if len(word) > 1 and word.isupper() else "a" if word else ""
        distinct[Q.bucket(b"w", low) if word else 0] = 1
        distinct[Q.bucket(b"p", low[: Q.STEM]) if len(low) > Q.STEM else Q.bucket(b"w", low) if word else 0] = 1
        s += weights[Q.bucket(b"s", t[:a][-2:] + case + (t[b:] if word else t)[:3])] * Q.SHAPE_SCALE / len(tokens)
    s += sum(weights[k] for k in distinct)
    if tokens:
        s += weights[Q.bucket(b"t", "again")] * Q.SHAPE_SCALE * sum(x == y for x, y in zip(tokens, tokens[1:], strict=False)) / len(tokens)
    below = [1 / (1 + np.exp(-(c - s))) for c in cuts]
    share = np.diff([0, *below, 1])
    return float(share @ np.array(levels, float)), 1 - below[-1]


def test_scores_equal_plain_sums(spark):
    rng = np.random.default_rng(4)
    model = rng.normal(size=Q.BUCKETS), np.array([-0.4, 0.9]), [0, 1, 2]
    words = ["walking", "walked", "WALK", "the", "the", "12", "%%%", "(well),", "«oui»", "a", "A", "Ünder!?", "x-y..."]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 40, 200)] + [None, "", "  ", "the " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in Q.score(df, model).collect():
        grade, tail = plain_score(texts[r.doc_id], *model)
        assert abs(r.expected_grade - grade) < 1e-3 and abs(r.tail_prob - tail) < 1e-3 and (r.keep == (r.tail_prob >= Q.SELECT_AT))


def test_fit_is_near_the_least_of_its_loss():
    """No small step of a weight or threshold, up or down, makes the penalised likelihood notably better."""
    rng = np.random.default_rng(1)
    n, width = 300, 12
    dense = (rng.random((n, width)) < 0.4).astype(float)
    grades = np.digitize(dense @ rng.normal(size=width) + rng.logistic(size=n), [-0.7, 0.8])
    rows, index = np.nonzero(dense)
    weights, cuts = Q.fit_cumulative(rows, index, np.ones(len(rows)), grades, 3)

    def loss(w, c):
        s = dense @ w
        edges = np.r_[-np.inf, c, np.inf]
        p = Q.sigmoid(edges[grades + 1] - s) - Q.sigmoid(edges[grades] - s)
        return -np.log(p).mean() + Q.PENALTY * np.abs(w).sum()

    best = loss(weights[:width], cuts)
    for k in range(width + 2):
        for step in (-0.05, 0.05):
            w, c = weights[:width].copy(), cuts.copy()
            if k < width:
                w[k] += step
            else:
                c[k - width] += step
            assert loss(w, c) > best - 2e-4
