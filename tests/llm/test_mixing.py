from collections import defaultdict
from fractions import Fraction
from itertools import islice
from math import ceil, floor

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import mixing as P


def slow_edf(weights, slots):
    """Every slot from the definitions, over all sources: release floor(j / w), deadline ceil((j + 1) / w)."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    share, done, out = {s: w / sum(exact.values()) for s, w in exact.items()}, dict.fromkeys(weights, 0), []
    for t in range(slots):
        open_ = [(ceil((done[s] + 1) / w), s) for s, w in share.items() if floor(done[s] / w) <= t]
        due, s = min(open_)
        out.append((s, done[s], floor(done[s] / share[s]), due))
        done[s] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.01, 100), min_size=1))
def test_slots_equal_slow_ones_and_stay_within_a_block(weights):
    slots = slow_edf(weights, 150)
    assert list(islice(P.pfair(P.exact_parts(weights)), 150)) == slots
    total, got = sum(map(Fraction, weights.values())), defaultdict(int)
    for t, (s, *_) in enumerate(slots, 1):
        got[s] += 1
        assert all(abs(got[x] - Fraction(w) / total * t) < 1 for x, w in weights.items())


def test_a_million_slots_stay_within_a_block_of_the_target():
    weights = {"a": 0.334, "b": 1 / 7, "rare": 1e-6, "rest": 1 - 0.334 - 1 / 7 - 1e-6}
    parts = P.exact_parts(weights)
    total, got = sum(parts.values()), dict.fromkeys(parts, 0)
    for t, (s, j, _, _) in enumerate(islice(P.pfair(parts), 1_000_000)):
        # lag is least just after a source's slot and largest just before one
        assert got[s] == j and j * total < parts[s] * (t + 1) and parts[s] * t < (j + 1) * total
        got[s] += 1
    assert all(abs(got[s] * total - parts[s] * 1_000_000) < total for s in parts) and got["rare"] in (1, 2)


def test_large_tables_have_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_BLOCKS", 50)
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source")
    got = P.mix(df).collect()
    assert len(got) == len({r.position for r in got}) == 3000 and len({r.slot for r in got}) <= 52


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 60), min_size=1), st.integers(1, 40))
def test_phases_cover_every_block_once(blocks, period):
    plan = P.phases(blocks, dict.fromkeys(blocks, 1.0), period)
    slots, seen = set(), defaultdict(set)
    for p in plan:
        for b in range(p["first_block"], p["last_block"] + 1):
            whole, part = divmod(b - p["first_block"], p["parts"])
            slot = p["first_slot"] + whole * p["period"] + p["places"][part]
            assert slot not in slots
            slots.add(slot)
            seen[p["source_key"]].add(b)
    assert slots == set(range(sum(blocks.values()))) and all(seen[s] == set(range(n)) for s, n in blocks.items())


def test_rows_follow_weights_without_loss(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}") for i in range(3000)] + [(None, "hot"), (7, None), (8, None), (8, None)]
    df = spark.createDataFrame([(i, s, 0) for i, s in rows], "doc_id long, source string, slot int").repartition(6)
    got = P.mix(df, {"hot": 3, "s0": 1, "s1": 1}, block_rows=8, period=40).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in got) == sorted((str(i), str(s)) for i, s in rows)
    assert len({r.position for r in got}) == len(rows) and all(r.release <= r.slot < r.deadline for r in got)
    blocks = {(r.source, r.block): r.slot for r in got}
    assert sorted(blocks.values()) == list(range(len(blocks)))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        by[r.source].append(-1 if r.doc_id is None else r.doc_id)
    assert all(ids == sorted(ids) for ids in by.values())


def test_empty_table(spark):
    assert P.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def lags(blocks, weights, slots):
    """The largest distance from the given weights while every source has blocks, in blocks."""
    order = {}
    for p in P.phases(blocks, weights, P.PERIOD):
        order.update({p["first_slot"] + x: p["source_key"] for x in p["places"]})
    total, got, most = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0), 0
    for t in range(slots):
        got[order[t]] += 1
        most = max(most, max(abs(got[s] - Fraction(w) / total * (t + 1)) for s, w in weights.items()) if t % 97 == 0 or t == slots - 1 else 0)
    return most


def test_many_periods_stay_within_a_block_of_the_given_weights():
    for weights in ({"a": 0.9} | {f"s{i}": 0.1 / 7 for i in range(7)}, {f"s{i:02}": (1000 + 37 * i) ** 0.5 for i in range(20)}):
        assert lags(dict.fromkeys(weights, 40 * P.PERIOD), weights, 20 * P.PERIOD) < 1
    many = {"a": 0.5} | {f"s{i:03}": 0.5 / 999 for i in range(999)}
    assert lags(dict.fromkeys(many, 8 * P.PERIOD), many, 4000) < 1


def test_rows_follow_weights_over_many_periods(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', concat('s', id % 7)) as source")
    weights = {"a": 0.9} | {f"s{i}": 0.1 / 7 for i in range(7)}
    got = P.mix(df, weights, block_rows=1, period=64).filter("slot < 20000 and source = 'a'").collect()
    assert abs(len(got) - 18_000) < 1 and all(r.release <= r.slot < r.deadline for r in got)
    assert all(r.release == r.block * 10 // 9 and r.deadline == -(-(r.block + 1) * 10 // 9) for r in got if r.block % 9 not in (0, 8))
