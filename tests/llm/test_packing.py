import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(counts, window):
    """Best-fit decreasing, an item at a time: what is left in each window."""
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in room if r >= length]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - length)
            else:
                room.append(window - length)
    return sorted(room)


def packed_counts(counts, window):
    room, following = P.Room(window), 0
    for length in sorted(counts, reverse=True):
        _, following = P.best_fit(room, window, length, counts[length], following)
    return sorted(c for c, runs in enumerate(room.runs) for _, n in runs for _ in range(n))


tables = st.sampled_from([7, 16, 60, 64]).flatmap(lambda w: st.tuples(st.just(w), st.dictionaries(st.integers(1, w), st.integers(1, 30), min_size=1, max_size=9)))


@settings(max_examples=150, deadline=None)
@given(tables)
def test_runs_pack_as_single_items(table):
    window, counts = table
    assert packed_counts(counts, window) == one_by_one(counts, window)


def padding(fills, window):
    return sum(window - f for f in fills if f & (f - 1))


@settings(max_examples=150, deadline=None)
@given(tables)
def test_plans_place_everything_once(table):
    window, counts = table
    made = P.plan(counts, window)
    length = np.concatenate([np.full(n, k) for k, n in counts.items()])
    key = np.concatenate([made.base[k] + np.arange(n) for k, n in counts.items()])
    row, at, size, where, offset, cut = P.placed(made, key, length)
    fills = Counter()
    for w, o, s in sorted(zip(where.tolist(), offset.tolist(), size.tolist(), strict=True)):
        assert fills[w] == o
        fills[w] += s
    assert sorted(fills) == list(range(made.windows)) and max(fills.values()) <= window
    own = defaultdict(list)
    for r, a, s, k in zip(row.tolist(), at.tolist(), size.tolist(), cut.tolist(), strict=True):
        own[r].append((a, s, k))
    for r, pieces in own.items():
        pieces.sort()
        assert [a for a, _, _ in pieces] == np.cumsum([0, *(s for _, s, _ in pieces)]).tolist()[:-1] and sum(s for _, s, _ in pieces) == length[r]
        assert [s for _, s, _ in pieces] == (P.powers_of(int(length[r])) if pieces[0][2] == 0 else [length[r]])


def test_plan_is_small_and_wastes_little():
    made = P.plan({k: 10**12 + 7 * k for k in range(1, 2049)})
    assert len(made.start) < 20_000
    for counts in ({1500: 99_999}, {1025: 10_001, 3: 5}, {k: 40 for k in range(900, 2049)}):
        window = P.WINDOW
        made = P.plan(counts, window)
        total = sum(k * n for k, n in counts.items())
        assert made.windows * window - total < total / P.SPARE + window


WORDS = ["Alpha", "beta,", "naïve", "<|endoftext|>", "x" * 300, "中文字", "it's", "ΣΑΣ", "1234", " ", " ", "\n\n", "a\tb", "İ", "é"]


def texts():
    rng = random.Random(5)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 40, 500, 2500]))) for _ in range(60)]
    return [*made, None, "", " ", "word " * 2047, "word " * 2046, "word " * 4095, "word " * 30_000, "same " * 700, "same " * 700]


def checked(rows, found, window, end_id):
    """Of the pieces: what the contract says; the padded tokens."""
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = Counter()
    ids_of = {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end_id]
        ids_of.setdefault((i, len(ids)), []).append(ids)
        want[i, len(ids)] += len(ids)
    got, fills = Counter(), Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills[r.sequence_id] and 1 <= r.length <= window
        fills[r.sequence_id] += r.length
        got[r.doc_id, r.doc_tokens] += r.length
        assert any(r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids_of[r.doc_id, r.doc_tokens])
    assert got == want and max(fills.values()) <= window and sorted(fills) == list(range(len(fills)))
    pieces = Counter((r.doc_id, r.doc_tokens, r.start, r.length) for r in found)
    for (i, n), own in ids_of.items():
        covered = np.zeros(n, int)
        for (d, k, start, length), times in pieces.items():
            if (d, k) == (i, n):
                covered[start : start + length] += times
        assert (covered == len(own)).all()
    return padding(fills.values(), window)


@pytest.mark.parametrize("window", [P.WINDOW, 100])
def test_pieces_equal_the_library(spark, window):
    rows = [(k // 2 if k % 9 else None, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, length int, shard string").repartition(4)
    found = P.pack(df, PATH, window, with_ids=True)
    pieces = found.collect()
    left = checked(rows, pieces, window, P.END_ID)
    total = sum(r.length for r in pieces)
    assert left < 0.05 * total + window
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
    put = P.sequences(found, window).collect()
    assert sum(r.n_tokens for r in put) == total
    assert all(len(r.ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else window) for r in put)
    by_place = {(r.sequence_id, r.offset): r for r in pieces}
    for s in put:
        first = by_place[s.sequence_id, 0]
        assert np.array(s.ids[: first.length], "<u4").tobytes() == first.ids


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    pieces = P.pack(docs, PATH).collect()
    assert checked(rows, pieces, P.WINDOW, P.END_ID) < 0.03 * sum(r.length for r in pieces)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
