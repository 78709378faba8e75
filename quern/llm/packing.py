"""Packing of token sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left of each, and each shorter document, is an
item, and items of one length are alike: best fit needs only how many there are of each length, at most `window` numbers
whatever the corpus. The driver packs those counts, longest first; a segment tree indexed by remaining capacity finds the
tightest open windows, which are held as runs of windows filled alike. A run takes many items of a length in one step, so
the plan is that of best-fit decreasing over single documents and its size depends on `window` alone. Tasks number the
items of each length by shard and order within it, and look up each one's window and offset in the plan.

Windows that would be left with more than a SPARE-th of their room are given up: their items are cut into lengths that
are powers of two, which fill remaining room, and each other, without waste; a window filled to a power of two isn't
padded either.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import batches, int64, materialize, texts
from quern.llm.lexicon import WordTokenizer
from quern.llm.tokens import Remembered

WINDOW, END_ID = 2048, 1
#: A window with more than a SPARE-th of its room left is given up.
SPARE = 16
ITEMS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("shard", pa.int32()), ("nth", pa.int64()), ("crc", pa.int64()), ("cut_crcs", pa.list_(pa.int64())), ("ids", pa.binary())])
ITEM_TYPES = "doc_id long, start long, length int, doc_tokens long, shard int, nth long, crc long, cut_crcs array<long>, ids binary"
RESULT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"


class WordIds:
    """Ids of a text as little-endian 32-bit bytes; words are remembered."""

    def __init__(self, path: str):
        self.tokenizer = WordTokenizer(path)
        self.pieces = Remembered(self._piece)

    def _plain(self, piece: str) -> bytes:
        tokenizer = self.tokenizer
        return array("I", [i for w in tokenizer.words(piece) for i in tokenizer.merge(w)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        pattern, special = self.tokenizer.special_pattern, self.tokenizer.special
        if pattern is None or not any(s in piece for s in special):
            return self._plain(piece)
        return b"".join(array("I", [special[p]]).tobytes() if p in special else self._plain(p) for p in pattern.split(piece))

    def __call__(self, text: str) -> bytes:
        # white space only parts words in this kind of tokenizer, so a text can be cut at any of it
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder for each worker process, so that its memory of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


class Room:
    """Runs (first window, number) of open windows by their remaining capacity, under a segment tree."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.any = [False] * (2 * self.half)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int) -> None:
        at, now = self.half + capacity, bool(self.runs[capacity])
        while at and self.any[at] != now:
            self.any[at] = now
            at >>= 1
            now = self.any[2 * at] or self.any[2 * at + 1] if at else now

    def push(self, capacity: int, first: int, windows: int) -> None:
        if windows:
            self.runs[capacity].append((first, windows))
            self._mark(capacity)

    def pop(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, length: int) -> int | None:
        """The least capacity of `length` or more that an open window has."""
        at = self.half + length
        while not self.any[at]:
            while at & 1:  # a right child: go up until there is a right neighbour
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.half:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.half


def best_fit(room: Room, window: int, length: int, n: int, following: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Put n items of a length where they fit best. Steps (items, first window, items a window, offset) in the order of the
    items, and the number of the next new window."""
    steps = []
    while n:
        capacity = room.tightest(length)
        if capacity is None:
            capacity, first, windows = window, following, -(-n // (window // length))
            following += windows
        else:
            first, windows = room.pop(capacity)
        each = capacity // length
        whole = min(windows, n // each)
        last = n - whole * each if whole < windows else 0  # of one more window
        last = min(last, each)
        if whole:
            steps.append((whole * each, first, each, window - capacity))
        if last:
            steps.append((last, first + whole, each, window - capacity))
        n -= whole * each + last
        room.push(capacity - each * length, first, whole)
        room.push(capacity - last * length, first + whole, bool(last))
        room.push(capacity, first + whole + bool(last), windows - whole - bool(last))
    return steps, following


@dataclass
class Plan:
    """Steps in the order of (class, number of the item in its class). Classes are the lengths, then window + 1 + k for
    cut pieces of 2 ** k. A step with first -1 cuts its items; `cuts` has where each power's pieces are numbered from."""

    base: np.ndarray
    start: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    cuts: np.ndarray
    windows: int


def plan(counts: dict[int, int], window: int = WINDOW, spare: int = SPARE) -> Plan:
    """The packing of counts[length] items of each length, none longer than the window."""
    powers = window.bit_length()
    room, following, packed = Room(window), 0, {}
    for length in sorted(counts, reverse=True):
        packed[length], following = best_fit(room, window, length, counts[length], following)
    # windows with much room are given up; full lengths of a power of two stay
    given: list[tuple[int, int]] = []
    for capacity in range(window // spare + 1, window + 1):
        fill = window - capacity
        if fill & (fill - 1):
            given += room.runs[capacity]
            while room.runs[capacity]:
                room.pop(capacity)
    given.sort()
    edges = [e for first, windows in given for e in (first, first + windows)]
    pieces, steps = [0] * powers, {}
    for length, found in packed.items():
        steps[length] = []
        for n, first, each, offset in found:
            while n:  # parts of a step lie between two edges, inside a run that is given up or outside
                k = bisect_right(edges, first)
                windows = -(-n // each)
                here = min(windows, edges[k] - first) if k < len(edges) else windows
                items = min(n, here * each)
                if k % 2:
                    steps[length].append((items, -1, 1, 0, list(pieces)))
                    pieces = [p + items * (length >> b & 1) for b, p in enumerate(pieces)]
                else:
                    steps[length].append((items, first, each, offset, None))
                n, first = n - items, first + here
    for b in reversed(range(powers)):
        found, following = best_fit(room, window, 1 << b, pieces[b], following)
        steps[window + 1 + b] = [(*s, None) for s in found]

    # windows are numbered anew without those that nothing is left in
    starts, ends = np.array(edges[::2], np.int64), np.array(edges[1::2], np.int64)
    lost = np.concatenate([[0], np.cumsum(ends - starts)])
    base, flat = np.zeros(window + powers + 2, np.int64), []
    at = 0
    for c in range(window + powers + 1):
        base[c] = at
        for items, first, each, offset, cuts in steps.get(c, ()):
            flat.append((at, first, each, offset, cuts or [0] * powers))
            at += items
    base[-1] = at
    first = np.array([f[1] for f in flat], np.int64)
    first = np.where(first < 0, first, first - lost[np.searchsorted(ends, first, "right")])
    column = lambda i: np.array([f[i] for f in flat], np.int64)
    return Plan(base, column(0), first, column(2), column(3), np.array([f[4] for f in flat], np.int64).reshape(-1, powers), following - int(lost[-1]))


def placed(made: Plan, key: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of items by their number over all classes: row, where in the item a piece begins, its length, window, offset, and
    which cut of the item it is (-1: the whole)."""
    step = np.searchsorted(made.start, key, "right") - 1
    nth = key - made.start[step]
    whole = np.flatnonzero(made.first[step] >= 0)
    found = [(whole, np.zeros(len(whole), np.int64), length[whole], step[whole], nth[whole], np.full(len(whole), -1))]
    cut = np.flatnonzero(made.first[step] < 0)
    powers = made.cuts.shape[1]
    begin = np.zeros(len(cut), np.int64)
    for b in reversed(range(powers)) if len(cut) else ():
        has = length[cut] >> b & 1 == 1
        rows = cut[has]
        numbers = made.base[len(made.base) - 1 - powers + b] + made.cuts[step[rows], b] + nth[rows]
        own = np.searchsorted(made.start, numbers, "right") - 1
        found.append((rows, begin[has], np.full(len(rows), 1 << b), own, numbers - made.start[own], np.bitwise_count(length[rows] >> (b + 1)).astype(np.int64)))
        begin[has] += 1 << b
    row, at, size, own, k, cut_of = (np.concatenate([f[i] for f in found]) for i in range(6))
    return row, at, size, made.first[own] + k // made.each[own], made.offset[own] + k % made.each[own] * size, cut_of


def powers_of(length: int) -> list[int]:
    """The powers of two that a cut item falls into, the largest first."""
    return [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]


def items(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every whole text as ids with the end id, cut at multiples of the window: doc_id, start, length, doc_tokens, the item's
    shard and its number among the items of its length there, checksums of its ids whole and if it were cut, and ids."""
    end = array("I", [end_id]).tobytes()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, seen = word_ids(tokenizer_path), TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in source:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                tokens = len(ids) // 4
                for start in range(0, tokens, window):
                    own = ids[4 * start : 4 * (start + window)]
                    length, cuts, at = len(own) // 4, [], 0
                    for n in powers_of(length) if length < window else ():
                        cuts.append(zlib.crc32(own[4 * at : 4 * (at + n)]))
                        at += n
                    rows.append((doc_id, start, length, tokens, shard, seen[length], zlib.crc32(own), cuts, own if with_ids else None))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(ITEMS), ITEMS, strict=True)], schema=ITEMS)

    return texts(docs).mapInArrow(run, ITEM_TYPES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every row and whole text of docs in sequences of at most `window` tokens: doc_id, start (ids of the document
    before the piece), length, doc_tokens, sequence_id, offset, ids_crc32 and, if wanted, ids (little-endian, 32 bits each).

    Each id lies in one piece, pieces follow each other in a sequence without gaps, sequences are numbered from 0. Null and
    empty texts are the end id alone; rows that repeat a doc_id are documents of their own, a null doc_id stays null. Ties
    (items of one length) go by shard and order there. An empty table gives an empty result.
    """
    rows = materialize(items(docs, tokenizer_path, window, end_id, with_ids), "packing-items")
    counts = materialize(rows.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `window` rows at most
    made = docs.sparkSession.sparkContext.broadcast(plan(totals, window))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "length", "before")

    def one(batch: pa.RecordBatch) -> dict:
        p, length = made.value, int64(batch.column("length"))
        row, at, size, window_of, offset, cut = placed(p, p.base[length] + int64(batch.column("before")) + int64(batch.column("nth")), length)
        parts = batch.take(pa.array(row))
        crcs = [whole if k < 0 else parts_of[k] for whole, parts_of, k in zip(parts.column("crc").to_pylist(), parts.column("cut_crcs").to_pylist(), cut.tolist(), strict=True)]
        found = {"doc_id": parts.column("doc_id"), "start": int64(parts.column("start")) + at, "length": size, "doc_tokens": parts.column("doc_tokens"), "sequence_id": window_of, "offset": offset, "ids_crc32": crcs}
        return found | {"ids": [x[4 * a : 4 * (a + n)] for x, a, n in zip(parts.column("ids").to_pylist(), at.tolist(), size.tolist(), strict=True)]} if with_ids else found

    schema = pa.schema([(c.split()[0], pa.int64()) for c in RESULT.split(", ")] + [("ids", pa.binary())] * with_ids)
    joined = rows.join(bases, ["shard", "length"]).select("doc_id", "start", "length", "doc_tokens", "nth", "before", "crc", "cut_crcs", *["ids"] * with_ids)
    return joined.mapInArrow(batches(one, schema), RESULT + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """What pack has placed with ids, put together: sequence_id, n_tokens (unpadded), ids (array), padded to the window unless the
    sequence is as long as a power of two. A group is one sequence."""

    def one(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group)).sort_by("offset")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4")
        n = len(ids)
        full = ids if n & (n - 1) == 0 else np.concatenate([ids, np.full(window - n, pad_id, "<u4")])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([full.astype(np.int64)], pa.list_(pa.int64()))], ["sequence_id", "n_tokens", "ids"])

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(one, "sequence_id long, n_tokens long, ids array<long>")
