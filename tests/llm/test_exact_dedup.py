import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import exact_dedup as D


def brute(rows):
    norm = {}
    for i, (doc_id, text) in enumerate(rows):
        import re

        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc_id, i))
    out = {}
    for group in norm.values():
        ids = [d for d, _ in group if d is not None]
        for d, i in group:
            out[i] = (d, min(ids) if ids else None, len(group))
    return sorted(map(str, out.values()))


def check(spark, rows, parts):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, keep_id string").repartition(parts)
    got = D.exact_dedup(df).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    return got


def test_groups_over_many_runs(spark):
    rows = [(i, f"a{' ' * (1 + i % 3)}text {i % 17 if i % 3 else 0}\n") for i in range(700)]
    check(spark, rows, 40)


def test_nulls_ties_and_long_texts(spark):
    rows = [(5, None), (4, ""), (None, ""), (None, "only"), (7, "x" * 300_000), (2, "x" * 300_000), (2, "x" * 300_000), (9, "a b"), (8, "a b")]
    got = check(spark, rows, 3)
    assert next(r for r in got if r.doc_id == 9).keep_id == 9


def test_empty_table(spark):
    assert D.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(-5, 5)), max_size=20), min_size=1, max_size=30))
def test_tree_of_runs_equals_one_merge(runs):
    def entries(pairs):
        e = np.empty(len(pairs), D.ENTRY)
        e["key"] = np.array([f"{k:040d}".encode() for k, _ in pairs], D.KEY) if pairs else np.empty(0, D.KEY)
        e["id"], e["rows"] = [i for _, i in pairs], 1
        return D.fold_entries(e)

    level = [entries(r) for r in runs]
    while len(level) > 1:
        level = [D.fold_entries(np.concatenate(level[i : i + D.FAN])) for i in range(0, len(level), D.FAN)]
    flat = entries([p for r in runs for p in r])
    assert (level[0] == flat).all() and len(level[0]) == len(flat)


def test_many_rounds_keep_every_key(spark):
    """More runs than one round merges: lanes are cut by key and nothing is lost."""
    df = spark.range(3000).selectExpr("id as doc_id", "concat('t', id % 500) as text").repartition(100)
    groups = D.keepers(D.digests(df)).collect()
    assert len(groups) == 500 and all(r.group_size == 6 for r in groups) and sorted(r.keep_id for r in groups) == list(range(500))
