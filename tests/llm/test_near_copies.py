import random

import corpus_pipeline as C
from quern.llm import near_copies as N
from quern.llm import simhash as S


def plain_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_components(rows):
    """By exact Jaccard of all pairs: the smallest id of each row's component."""
    sets, parent = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


def edited(words, edits, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def table():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (None, "one two"), (None, "a text that nobody else has here"), (2, "")]
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        rows += [(10 + len(rows), edited(words, e, rng)) for e in (0, 1, len(words) // 60, len(words) // 45, len(words) // 30)]
    # a chain whose ends differ, and a ball of copies of one text
    words = [f"c{i}" for i in range(400)]
    rows += [(5000 + k, " ".join(words[k * 15 : k * 15 + 200])) for k in range(12)]
    rows += [(6000 + k, edited(words, 3, rng)) for k in range(60)]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = table()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int").repartition(4)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in N.near_copies(df).collect())
    assert got == sorted((str(d), str(c)) for (d, _), c in zip(rows, plain_components(rows), strict=True))


def test_stage_takes_what_fingerprints_miss(spark):
    rows = [(d, t) for d, t in table() if d is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = set(plain_components(rows))
    assert {r.doc_id for r in C.near(spark, df, "").collect()} == want
    assert len({r.component_id for r in S.near_duplicates(df).collect()}) > len(want)


def test_empty_table(spark):
    assert N.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_radius_reaches_the_links(spark):
    df = spark.createDataFrame([(0,), (31,)], "fp long")
    assert S.links(df, 2).filter("a <> b").count() == 0 and S.links(df, 2, radius=5).filter("a <> b").count() == 1


def test_signatures_count_equal_minhashes(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(50):
        a = [rng.randrange(256) for _ in range(N.BANDS * N.ROWS)]
        b = [x if rng.random() < 0.6 else rng.randrange(256) for x in a]
        rows.append((*(N.np.array(v, N.np.uint8).view(N.np.int64).tolist() for v in (a, b)), sum(x == y for x, y in zip(a, b, strict=True))))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, n int")
    assert df.filter(N.equal_minhashes("x", "y") != N.F.col("n")).count() == 0


def test_fingerprints_by_trees_find_candidates(spark):
    """Texts whose fingerprints trees link share a bucket, without any band of minhashes."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "one", "more"])), (3, " ".join(other)), (4, " ".join(["first", *other]))]
    fps = [N.set_fingerprint(N.shingle_set(t.encode(), 5)) & (2**64 - 1) for _, t in rows]
    assert (fps[0] ^ fps[1]).bit_count() <= S.RADIUS and (fps[0] ^ fps[2]).bit_count() > S.RADIUS
    distinct = spark.createDataFrame([(i, 9, f - 2**64 if f >= 2**63 else f) for (i, _), f in zip(rows, fps)], "node long, size int, fp long")
    bands = {r.node: r.band for r in N.fingerprint_buckets(distinct).collect()}
    assert bands[1] == bands[2] and bands[1] != bands.get(3)


def test_pairs_of_one_group_that_fall_short_make_no_rows(spark, monkeypatch):
    """Copies of one text with many edits share bands and aren't linked: few of their pairs reach the exact comparison."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, edited(words, rng.choice((0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 7, 8)), rng)) for i in range(240)]
    compared, confirm = [], N.confirmed

    def counted(pairs, sets):
        compared.append(pairs.count())
        return confirm(pairs, sets)

    monkeypatch.setattr(N, "confirmed", counted)
    got = sorted((r.doc_id, r.component_id) for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == sorted((d, c) for (d, _), c in zip(rows, plain_components(rows), strict=True))
    assert len({c for _, c in got}) > 60 and compared[1] <= 2 * len(rows), compared


def test_parities_lose_no_link(spark):
    rng = random.Random(12)
    made = []
    for size in (1, 9, 40, 150, 3000):
        for _ in range(12):
            base = [rng.randrange(2**63) for _ in range(size)]
            other = base[: size - rng.randrange(size // 6 + 1)] + [rng.randrange(2**63) for _ in range(rng.randrange(size // 6 + 1))]
            a, b = set(base), set(other)
            of = lambda s: N.parities(N.np.array(sorted(s), N.np.uint64)).tolist()
            made.append((len(a), of(a), len(b), of(b), 5 * len(a & b) >= 4 * len(a | b)))
    df = spark.createDataFrame(made, "size int, p array<long>, size_b int, q array<long>, linked boolean")
    can = N.can_be_linked("size", "p", "size_b", "q")
    assert df.filter("linked").count() > 10 and df.filter(N.F.col("linked") & ~can).count() == 0
    assert df.filter(~N.F.col("linked") & ~can).count() > 5
