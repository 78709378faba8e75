import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import simhash as S


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_rows_equal_brute_force(spark):
    base = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 8
    rows = [(i, base + ("tail " if i % 5 else "other ") + ("x" if i % 7 == 0 else "")) for i in range(50, 10, -1)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (None, "lonely text that nobody else has"), (60, "w" * 50_000), (61, "ü Ü b"), (2, "")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string").repartition(4)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.near_duplicates(df).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, _), f, c in zip(rows, fps, plain_components(fps, [i for i, _ in rows]), strict=True))
    assert got == want


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def fingerprints_with_balls(seed, n, ball):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, n, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 1 + i % 4, replace=False).astype(np.uint64)) for i in range(ball)], np.uint64)
    return np.unique(np.concatenate([x, x[0] ^ flips]))


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 1500), st.integers(0, 900), st.integers(1, 20))
def test_shards_lose_no_link(seed, n, ball, leaves):
    x = fingerprints_with_balls(seed, n, ball)
    nodes = S.build_tree(x[::3], leaves)
    at, leaf, home = S.route(nodes, x, 3)
    assert home.sum() == len(x)
    found = set()
    for s in np.unique(leaf):
        members, queries = at[(leaf == s) & home], at[leaf == s]
        for i, j in S.near_pairs(x[queries], x[members], 3):
            for a, b in zip(queries[i].tolist(), members[j].tolist(), strict=True):
                found |= {(a, b), (b, a)}
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    assert found == set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize(("block", "shard", "sample", "rounds"), [(300, 800, 20_000, 8), (200, 100, 60, 8), (200, 100, 60, 1), (5_000, 20, 20_000, 8)])
def test_large_shards_are_split_or_dealt_in_blocks(spark, monkeypatch, block, shard, sample, rounds):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("SAMPLE", sample), ("ROUNDS", rounds)):
        monkeypatch.setattr(S, name, value)
    x = fingerprints_with_balls(3, 1500, 900)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(3)
    labels = {r.node: r.label for r in S.components(S.links(df, len(x))).collect()}
    ids = x.view(np.int64).tolist()
    want = plain_components([int(v) for v in x], ids)
    assert [labels.get(i, i) for i in ids] == want


def test_the_sample_is_a_filter_of_about_its_size(spark):
    df = spark.range(200_000).selectExpr("id as fp")
    assert 19_000 < df.filter(S.sampled(200_000)).count() < 21_000 and df.filter(S.sampled(100)).count() == 200_000
    assert "TakeOrdered" not in df.filter(S.sampled(200_000))._jdf.queryExecution().toString()


def test_forest_has_bounded_degree():
    root = np.zeros(1000, int)
    a, b = S.forest_edges(np.arange(1000), root)
    assert len(a) == 999 and max(np.bincount(b)) <= S.DEGREE


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.label for r in S.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
