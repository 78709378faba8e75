"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - s), where s is a sum of weights shared by all grades over a text's hashed features
and the thresholds ascend. That gives the expected grade and the tail probability of the best grade. Features are the
distinct words and word stems of the text (1 each; a stem is a word's first letters), its token shapes by their share of tokens (the marks around a word and whether it is
written in capitals or digits) and the share of tokens that repeat the one before.

Weights are fitted on a bounded sample of rated documents (TRAIN_ROWS, those with the least hash of doc_id), with a
penalty on their absolute values, so that few words carry weight and long texts don't add up chance; scoring covers every
row and whole texts, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, expose_package, texts

BUCKETS = 1 << 17
#: Documents that the fit reads at most.
TRAIN_ROWS = 8_000
ROUNDS = 200
PENALTY = 2e-4
RATE = 0.05
#: Features of fewer sampled rows keep weight 0.
LEAST_ROWS = 6
#: Letters of a stem; shorter words are their own.
STEM = 4
#: What a whole text of one shape adds, against 1 for a word.
SHAPE_SCALE = 4.0
#: A row is selected if its best grade is at least this probable.
SELECT_AT = 0.5
#: Entries of a worker's token cache.
CACHE = 400_000
#: Stripped from the ends of a token to find its word.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»‹›“”„‘’‚–—…·"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_prob", pa.float64()), ("keep", pa.bool_())])
RESULT = "doc_id long, expected_grade double, tail_prob double, keep boolean"
_cache: dict[str, int] = {}


def bucket(kind: bytes, value: str) -> int:
    return zlib.crc32(value.encode("utf-8", "replace"), zlib.crc32(kind)) % BUCKETS


def token_buckets(token: str) -> int:
    """The buckets of a token's word (0: none), of its stem and of its shape, as one number."""
    word = token.strip(MARKS)
    at = token.find(word)
    case = "9" if word.isdigit() else "A" if len(word) > 1 and word.isupper() else "a" if word else ""
    shape = f"{token[:at][-2:]}{case}{token[at + len(word) :][:3]}"
    low = word.lower()
    whole = bucket(b"w", low) if word else 0
    stem = bucket(b"p", low[:STEM]) if len(low) > STEM else whole
    return (whole * BUCKETS + stem) * BUCKETS + bucket(b"s", shape)


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text; one bucket at least."""
    tokens = text.split()
    if not tokens:
        return np.array([bucket(b"t", "empty")], np.int32), np.ones(1, np.float32)
    counts = Counter(tokens)
    if len(_cache) > CACHE:
        _cache.clear()
    for t in counts:
        if t not in _cache:
            _cache[t] = token_buckets(t)
    words, kinds = np.divmod(np.fromiter(map(_cache.__getitem__, counts), np.int64, len(counts)), BUCKETS)
    words = np.unique(np.concatenate(np.divmod(words, BUCKETS)))
    shapes, at = np.unique(kinds, return_inverse=True)
    share = np.bincount(at, weights=np.fromiter(counts.values(), float, len(counts))) / len(tokens)
    again = sum(map(str.__eq__, tokens, tokens[1:])) / len(tokens)
    index = np.concatenate([words, shapes, [bucket(b"t", "again")]]).astype(np.int32)
    value = np.concatenate([np.ones(len(words)), SHAPE_SCALE * share, [SHAPE_SCALE * again]]).astype(np.float32)
    return index, value


def feature_batch(batch: pa.RecordBatch) -> dict:
    found = [text_features(t) for t in batch.column("text").to_pylist()]
    return {"grade": batch.column("grade"), "index": [i for i, _ in found], "value": [v for _, v in found]}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative(rows: np.ndarray, index: np.ndarray, value: np.ndarray, grades: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the negative log likelihood, each step followed by the soft threshold
    of the penalty. rows, index, value: sparse features."""
    n = len(grades)
    known = np.bincount(index, minlength=BUCKETS) >= min(LEAST_ROWS, n)
    rows, value, index = rows[known[index]], value[known[index]], (np.cumsum(known) - 1)[index[known[index]]]
    features = int(known.sum())
    weights, cuts = np.zeros(features), np.linspace(-1, 1, levels - 1) if levels > 2 else np.zeros(levels - 1)
    state = [np.zeros(features + levels - 1) for _ in range(2)]
    for t in range(1, ROUNDS + 1):
        s = np.bincount(rows, weights=value * weights[index], minlength=n)
        low, high = np.r_[-np.inf, cuts][grades], np.r_[cuts, np.inf][grades]
        a, b = sigmoid(high - s), sigmoid(low - s)
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        by_score = (da - db) / n
        slope = np.bincount(index, weights=by_score[rows] * value, minlength=features)
        by_cut = np.array([(db[grades == k + 1].sum() - da[grades == k].sum()) / n for k in range(levels - 1)])
        g = np.r_[slope, by_cut]
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        rate = RATE / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        step = rate * state[0] / (1 - 0.9**t)
        weights -= step[:features]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - PENALTY * rate[:features], 0)
        cuts = np.sort(cuts - step[features:])
    out = np.zeros(BUCKETS)
    out[known] = weights
    return out, cuts


def fit(docs: DataFrame, ratings: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(weights, thresholds, grades) from ratings (doc_id, grade) of docs. Ratings that repeat a doc_id keep the least
    grade and, of texts that repeat one, the least is read; null grades are ignored. Fewer than two grades give a model that keeps everything."""
    known = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    # the least hashes are below a bound that leaves half as many again, so few rows of each partition are sorted
    share = min(1.0, 1.5 * TRAIN_ROWS / max(1, known.count()))
    few = known.filter(F.xxhash64("doc_id") <= F.lit(int(min(2**63 - 1, -(2**63) + share * 2**64))))
    sample = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rated = texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    schema = pa.schema([("grade", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
    found = rated.select("text", F.col("grade").cast("int")).mapInArrow(batches(feature_batch, schema), "grade int, index array<int>, value array<float>").toArrow()
    grades = found.column("grade").to_numpy()
    levels = sorted(set(grades.tolist()))
    if len(levels) < 2:
        return np.zeros(BUCKETS), np.empty(0), levels
    index = found.column("index").combine_chunks()
    sizes = np.diff(index.offsets.to_numpy())
    rows = np.repeat(np.arange(len(grades)), sizes)
    weights, cuts = fit_cumulative(rows, index.values.to_numpy(), found.column("value").combine_chunks().values.to_numpy(), np.searchsorted(levels, grades), len(levels))
    return weights, cuts, levels


def grader(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, list[int]]):
    """A function from texts to (expected grade, tail probability of the best grade) in tasks."""
    weights, cuts, levels = model
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), cuts, np.array(levels or [0], float)))

    def grade(found: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        weights, cuts, levels = shared.value
        s = np.array([float(weights[i] @ v) for i, v in (text_features(t or "") for t in found)])
        below = np.concatenate([np.zeros((len(s), 1)), sigmoid(cuts[None, :] - s[:, None]), np.ones((len(s), 1))], axis=1)
        return np.diff(below, axis=1) @ levels, 1 - below[:, -2]

    return grade


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, list[int]], select_at: float = SELECT_AT) -> DataFrame:
    """doc_id, expected_grade, tail_prob (of the best grade) and keep, for every row of docs."""
    grade = grader(docs, model)

    def one(batch: pa.RecordBatch) -> dict:
        expected, tail = grade(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "expected_grade": expected, "tail_prob": tail, "keep": tail >= select_at}

    return texts(docs).mapInArrow(batches(one, SCHEMA), RESULT)


def select(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, list[int]], select_at: float = SELECT_AT) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns and without a join."""
    expose_package(docs.sparkSession)
    grade = grader(docs, model)
    return docs.mapInArrow(batches(lambda batch: batch.filter(pa.array(grade(batch.column("text").to_pylist())[1] >= select_at))), docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings from the labels table: 0 poor, 1 well written but toxic, 2 well written and clean."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def classify(docs: DataFrame, labels: DataFrame, select_at: float = SELECT_AT) -> DataFrame:
    """Fit on labels of docs and score every row of docs. Null and empty texts are texts without tokens."""
    return score(docs, fit(docs, grades_of(labels)), select_at)
