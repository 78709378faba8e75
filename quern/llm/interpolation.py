"""LM scoring by deleted interpolation.

P(w | v) = a_b * c(v, w) / c(v) + b_b * c(w) / N + g_b / (V + 1), where b is the bucket of v's frequency (0, then powers of
two) and the weights of each bucket are learnt by expectation-maximisation on held-out counts: every training token is
held out in turn, which takes one from each count that it is part of and from the frequency that its bucket goes by. A
text's first word follows the end mark.

Counts are fetched by those who need them. Texts are cut into tokens once, in slices of SLICE bytes, and written as packed
arrays. A slice asks for each of its distinct words, and then for each of its distinct word pairs, once: what it has of
them goes to a bucket by hash, the bucket adds up and returns the sums in the same order. So a word or pair that makes up
a third of the corpus is one item a slice, no word or pair is left out, and no table of words or pairs is ever in one
place. The buckets of pairs also add up the histogram that expectation-maximisation reads. Words and pairs are told apart
by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import byte_text, int64, materialize, texts
from quern.llm.simhash import BLANKS, LOWER

#: Training tokens for each bucket.
BUCKET_TOKENS = 3_000_000
#: Bytes of text in a slice, if no single text is longer.
SLICE = 4 << 20
LEVELS = 64
ROUNDS = 60
SEED = 7
END = b""
#: Steps of a binary logarithm in the histogram that EM reads; 0 stands for probability 0.
STEPS = 8
OFFSET = 1 << 10
STEP_BITS = 12
STEP_MASK = (1 << STEP_BITS) - 1
TOKENS = "slice long, n_train long, ids binary, nulls binary, train binary, sizes binary, places binary, hashes binary, counts binary"
TOKEN_SCHEMA = pa.schema([("slice", pa.int64()), ("n_train", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "train", "sizes", "places", "hashes", "counts"))])
ASKED = "bucket int, slice long, key binary, n binary, s1 binary, p1 binary"
ASKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), *((c, pa.binary()) for c in ("key", "n", "s1", "p1"))])
#: What a bucket returns: to a slice its counts, and of its own (slice null) a histogram.
ANSWER = "slice long, bucket int, counts binary, cells binary, weights binary, seen long"
ANSWER_SCHEMA = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("counts", "cells", "weights")), ("seen", pa.int64())])


def pack(x: np.ndarray, ordered: bool = False) -> bytes:
    """Compressed; ordered integers as differences, bytes of equal rank together."""
    if ordered and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T) if len(x) else np.empty(0, np.uint8)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, dtype: str, ordered: bool = False) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.decompress(data) if data else b"", np.uint8), np.dtype(dtype).itemsize
    x = np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype) if len(raw) else np.empty(0, dtype)
    return np.cumsum(x, dtype=dtype) if ordered else x


def joined(parts: list[np.ndarray], dtype: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def dealing(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a slice deals its distinct keys, which are hashes, by ranges: their order, the buckets and where each begins."""
    order = np.argsort(keys)
    found, starts = np.unique(((keys[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32), return_index=True)
    return order, found, starts


# --- tokens of slices


def token_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, ascending hashes of distinct tokens, each token's place among them, tokens of each row), a slice of
    rows at a time."""
    text, first = byte_text(batch.column("text")), 0
    while first < len(text):
        flat: list[bytes] = []
        sizes: list[int] = []
        size, at = 0, first
        while at < len(text) and (size < SLICE or at == first):
            words = text[at].translate(LOWER).translate(BLANKS).split(b" ")
            if END in words:
                words = [w for w in words if w]
            flat += words
            flat.append(END)
            sizes.append(len(words) + 1)
            size += len(text[at])
            at += 1
        distinct = list(set(flat))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct))
        order = np.argsort(hashes)
        place = dict(zip(map(distinct.__getitem__, order), range(len(distinct)), strict=True))
        yield first, hashes[order], np.fromiter(map(place.__getitem__, flat), np.uint32, len(flat)), np.array(sizes, np.uint32)
        first = at


def tokenise(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slice; counts are of training tokens, in the order of hashes."""
    number = TaskContext.get().partitionId() << 33
    for batch in source:
        ids, train = batch.column("doc_id"), batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
        for first, hashes, places, sizes in token_slices(batch):
            own, flags = ids.slice(first, len(sizes)), train[first : first + len(sizes)]
            counts = np.bincount(places, weights=np.repeat(flags, sizes), minlength=len(hashes)).astype(np.uint32)
            made = {
                "slice": [number],
                "n_train": [int(counts.sum())],
                "ids": [pack(int64(own.fill_null(0)))],
                "nulls": [pack(own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))],
                "train": [pack(flags)],
                "sizes": [pack(sizes)],
                "places": [pack(places)],
                "hashes": [pack(hashes, True)],
                "counts": [pack(counts)],
            }
            number += 1
            yield pa.RecordBatch.from_pydict(made, TOKEN_SCHEMA)


class Slice:
    """A slice's tokens, as arrays."""

    def __init__(self, table: pa.Table):
        row = table.to_pylist()[0]
        self.number = row["slice"]
        self.ids, self.nulls, self.train = (unpack(row[c], t) if c in row else None for c, t in (("ids", "<i8"), ("nulls", "u1"), ("train", "u1")))
        self.sizes, self.hashes = unpack(row["sizes"], "<u4").astype(np.int64), unpack(row["hashes"], "<u8", True)
        places = unpack(row["places"], "<u4").astype(np.int64)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        # the token before each; before a row's first token, the end mark
        before = np.empty_like(places)
        before[1:] = places[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = places[-1]
        keys, self.pair = np.unique(before << 32 | places, return_inverse=True)
        #: of each distinct pair, the places of its words
        self.left, self.right = keys >> 32, keys & 0xFFFFFFFF

    def pair_hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(self.hashes[self.left] * np.uint64(0x9E3779B97F4A7C15) + mixed(self.hashes[self.right]))

    def answered(self, keys: np.ndarray, answers: list[dict], buckets: int) -> np.ndarray:
        """Counts of keys, put together from what each bucket returned."""
        order, _, _ = dealing(keys, buckets)
        counts = np.empty(len(keys), np.int64)
        counts[order] = joined([unpack(r["counts"], "<i8") for r in sorted(answers, key=lambda r: r["bucket"])], "<i8")
        return counts


# --- what slices ask and buckets answer


def asked(number: int, buckets: int, keys: np.ndarray, n: np.ndarray, s1: np.ndarray | None = None, p1: np.ndarray | None = None) -> pa.RecordBatch:
    order, found, starts = dealing(keys, buckets)
    made: dict[str, list] = {c: [] for c in ASKED_SCHEMA.names}
    for bucket, s, e in zip(found.tolist(), starts, [*starts[1:], len(order)], strict=True):
        own = order[s:e]
        values = (bucket, number, pack(keys[own], True), pack(n[own].astype(np.uint32)), b"" if s1 is None else pack(s1[own].astype(np.uint16)), b"" if p1 is None else pack(p1[own].astype(np.uint16)))
        for c, v in zip(ASKED_SCHEMA.names, values, strict=True):
            made[c].append(v)
    return pa.RecordBatch.from_pydict(made, ASKED_SCHEMA)


def ask_words(buckets: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for number, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "hashes", "counts")), strict=True):
                yield asked(number, buckets, unpack(hashes, "<u8", True), unpack(counts, "<u4"))

    return run


def ask_pairs(buckets: int, tokens: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Slice(left)
        counts = own.answered(own.hashes, right.to_pylist(), buckets)
        n = np.bincount(own.pair, weights=own.train[own.row], minlength=len(own.left))
        p1 = step((counts[own.right] - 1) / max(tokens - 1, 1))
        return pa.Table.from_batches([asked(own.number, buckets, own.pair_hashes(), n, count_step(counts[own.left] - 1), p1)])

    return run


def step(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-30)) * STEPS).astype(np.int64) + OFFSET, 0)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The bucket of a frequency: 0 for 0, k for 2 ** (k - 1) to 2 ** k - 1."""
    return np.minimum(np.frexp(np.maximum(counts, 0).astype(float))[1], LEVELS - 1)


def count_step(counts: np.ndarray) -> np.ndarray:
    """A frequency in steps of its binary logarithm, rounded down; 0 for 0."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1)) * STEPS).astype(np.int64), 0)


def code(c12: np.ndarray, s1: np.ndarray, p1_step: np.ndarray) -> np.ndarray:
    """A cell of the histogram: the level of a context, in steps s1, and the steps of both probabilities."""
    level = np.where(s1 > 0, 1 + (s1 - 1) // STEPS, 0).astype(np.int64)
    p2 = np.where(s1 > 0, c12 / 2.0 ** ((s1 - 0.5) / STEPS), 0.0)
    return np.minimum(level, LEVELS - 1) << 2 * STEP_BITS | step(np.minimum(p2, 1.0)) << STEP_BITS | p1_step


def answer(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's sums: to each slice those of its keys, and once the number of keys with training tokens and, of pairs,
    the histogram of their held-out probabilities."""
    rows = [r for batch in group for r in batch.to_pylist()]
    keys = [unpack(r["key"], "<u8", True) for r in rows]
    first = np.cumsum([0, *map(len, keys)])
    every, n = joined(keys, "<u8"), joined([unpack(r["n"], "<u4") for r in rows], "<u4").astype(np.int64)
    del keys
    order = np.argsort(every, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = every[order[1:]] != every[order[:-1]]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(n[order], starts)
    counts = np.empty(len(order), np.int64)
    counts[order] = sums[np.cumsum(new) - 1]
    for r, s, e in zip(rows, first[:-1], first[1:], strict=True):
        yield pa.RecordBatch.from_pydict({"slice": [r["slice"]], "bucket": [r["bucket"]], "counts": [pack(counts[s:e])], "cells": [None], "weights": [None], "seen": [0]}, ANSWER_SCHEMA)
    cells, weights, seen = b"", b"", sums > 0
    if rows[0]["s1"]:
        one = order[starts[seen]]
        s1, p1 = (joined([unpack(r[c], "<u2") for r in rows], "<u2")[one].astype(np.int64) for c in ("s1", "p1"))
        c12 = sums[seen]
        found, at = np.unique(code(c12 - 1, s1, p1), return_inverse=True)
        cells, weights = pack(found), pack(np.bincount(at, weights=c12, minlength=len(found)).astype(np.int64))
    yield pa.RecordBatch.from_pydict({"slice": [None], "bucket": [rows[0]["bucket"]], "counts": [None], "cells": [cells], "weights": [weights], "seen": [int(seen.sum())]}, ANSWER_SCHEMA)


def opened(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for cells, weights in zip(batch.column("cells").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            yield pa.RecordBatch.from_pydict({"key": unpack(cells, "<i8"), "n": unpack(weights, "<i8")})


# --- weights and scores


def expectation_maximisation(histogram: np.ndarray, weight: np.ndarray, distinct: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each level, as (LEVELS, 3)."""
    level, s2, s1 = histogram >> 2 * STEP_BITS, histogram >> STEP_BITS & STEP_MASK, histogram & STEP_MASK
    parts = np.stack([np.where(s > 0, 2.0 ** ((s - OFFSET) / STEPS), 0.0) for s in (s2, s1)] + [np.full(len(level), 1 / (distinct + 1))], axis=1)
    mix = np.full((LEVELS, 3), 1 / 3)
    # a context that was never seen has no bigrams
    mix[0] = (0, 0.5, 0.5)
    for _ in range(ROUNDS):
        share = parts * mix[level]
        share *= (weight / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        # a trace of each count keeps weights of levels without tokens, and of parts that held-out tokens never used
        got = np.stack([np.bincount(level, weights=share[:, k], minlength=LEVELS) for k in range(3)], axis=1) + 1e-3 * mix
        mix = got / got.sum(axis=1, keepdims=True)
    return mix


def log_mix(mix: np.ndarray, tokens: int, distinct: int, c1: np.ndarray, c12: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """log10 of the model's probability."""
    own = mix[level_of(c1)]
    return np.log10(own[:, 0] * c12 / np.maximum(c1, 1) + own[:, 1] * c2 / max(tokens, 1) + own[:, 2] / (distinct + 1))


RESULT = "doc_id long, n_tokens long, n_known long, base double, score double"


def score_slice(mix: np.ndarray, buckets: int, tokens: int, distinct: int):
    """The rows of a slice, from its tokens and the counts that were returned to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, answers = Slice(left), right.to_pylist()
        counts = own.answered(own.hashes, [r for r in answers if not r["pairs"]], buckets)
        c12 = own.answered(own.pair_hashes(), [r for r in answers if r["pairs"]], buckets)
        c2 = counts[own.right]
        score, base = log_mix(mix, tokens, distinct, counts[own.left], c12, c2), np.log10((c2 + 1) / (tokens + distinct + 1))
        n = len(own.sizes)
        sums = [np.bincount(own.row, weights=x[own.pair], minlength=n) for x in (c2 > 0, base, score)]
        return pa.table({"doc_id": pa.array(own.ids, mask=own.nulls > 0), "n_tokens": own.sizes, "n_known": sums[0].astype(np.int64), "base": sums[1], "score": sums[2]})

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def interpolated_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs and whole texts.

    Null and empty texts are the end mark alone. Rows that repeat a doc_id are scored each on its own. A null doc_id is
    not held out. Without training rows every count is 0 and every log probability that of the uniform part. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("train", ~held_out(F.col("doc_id")))
    slices = materialize(rows.mapInArrow(tokenise, TOKENS), "lm-tokens")
    tokens = slices.agg(F.sum("n_train")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
    words = slices.select("slice", "hashes", "counts").mapInArrow(ask_words(buckets), ASKED)
    words = materialize(words.groupBy("bucket").applyInArrow(answer, ANSWER), "lm-words")
    distinct = words.filter("slice is null").agg(F.sum("seen")).first()[0] or 0
    counts = words.filter("slice is not null").select("slice", "bucket", "counts", F.lit(False).alias("pairs"))
    pairs = slices.select("slice", "train", "sizes", "places", "hashes").groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(ask_pairs(buckets, tokens), ASKED)
    pairs = materialize(pairs.groupBy("bucket").applyInArrow(answer, ANSWER), "lm-pairs")
    cells = pairs.filter("slice is null").select("cells", "weights").mapInArrow(opened, "key long, n long")
    histogram = cells.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    mix = expectation_maximisation(histogram["key"].to_numpy(np.int64), histogram["n"].to_numpy(float), distinct)
    every = counts.unionByName(pairs.filter("slice is not null").select("slice", "bucket", "counts", F.lit(True).alias("pairs")))
    scored = slices.drop("n_train", "train", "counts").groupBy("slice").cogroup(every.groupBy("slice")).applyInArrow(score_slice(mix, buckets, tokens, distinct), RESULT)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
