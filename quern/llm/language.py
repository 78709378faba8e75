"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything that is no letter becomes a blank; character 1- to 3-grams are hashed to BUCKETS.
Training adds up n-gram counts by language (one small count table per task, summed by Spark); the matrix of smoothed
log probabilities, languages by BUCKETS, is broadcast. Scoring multiplies sparse rows of n-gram counts, a batch of texts at a
time, with the matrix in numpy. Long texts are read in slices that overlap by what an n-gram needs, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, texts

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
#: The matrix takes this many languages times BUCKETS floats; more are refused.
MOST_LANGUAGES = 200
NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
HAS_LETTER = regex.compile(r"\p{L}")
RESULT = "doc_id long, lang_pred string, score double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
#: Odd multipliers of the n-gram hash.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
#: Characters of a slice, and slices that are scored together.
SLICE = 1 << 18
GROUP = 64
#: Log probabilities that are added up at a time.
CELLS = 1 << 21


def letters(text: str) -> str:
    return f" {NO_LETTER.sub(' ', text.lower()).strip()} "


def ngrams(text: str, first: int = 0) -> np.ndarray:
    """Hashed n-grams of letters(text), all orders, that end at character `first` or later."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    out, held = [], np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(points) < n:
                break
            held = (held[: len(points) - n + 1] ^ points[n - 1 :]) * MIX[n - 1]
            held ^= held >> np.uint32(15)
            out.append(((held * MIX[2]) >> np.uint32(17)).astype(np.int32)[max(0, first - n + 1) :])
    return np.concatenate(out)


def sliced_ngrams(text: str) -> Iterator[np.ndarray]:
    """ngrams(text), a slice at a time; a slice begins with the last characters of the one before."""
    more = max(ORDERS) - 1
    for a in range(0, len(text), SLICE):
        lead = min(a, more)
        yield ngrams(text[a - lead : a + SLICE], lead)


def count_task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's n-gram counts, one row a language; the last count is of texts."""
    totals: dict[str, np.ndarray] = {}
    for batch in source:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            if HAS_LETTER.search(text):
                have = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                have[BUCKETS] += 1
                for found in sliced_ngrams(letters(text)):
                    have[:BUCKETS] += np.bincount(found, minlength=BUCKETS)
    if totals:
        yield pa.RecordBatch.from_pydict({"label": list(totals), "counts": list(totals.values())})


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities) from (text, label) rows, over every row and whole texts.

    Each task sends one row of counts for each language; the sums have languages x BUCKETS entries, whatever the input.
    Languages are counted first: more than MOST_LANGUAGES raise ValueError before anything is gathered.
    """
    named = labelled.select("label").distinct().limit(MOST_LANGUAGES + 1).count()
    if named > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages, which is what fit() takes")
    parts = labelled.mapInArrow(count_task, "label string, counts array<long>")
    cells = parts.select("label", F.posexplode("counts").alias("bucket", "n")).filter("n > 0")
    sums = cells.groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).toArrow()  # a row for each language
    order = sorted(range(packed.num_rows), key=lambda i: packed.column("label")[i].as_py())
    langs = [packed.column("label")[i].as_py() for i in order]
    counts = np.zeros((len(langs), BUCKETS + 1))
    for k, i in enumerate(order):
        own = packed.column("cells")[i].values
        counts[k, own.field("bucket").to_numpy()] = own.field("n").to_numpy()
    seen, cells = counts[:, BUCKETS], counts[:, :BUCKETS] + SMOOTHING
    return langs, np.log(seen / max(seen.sum(), 1)), np.log(cells / cells.sum(axis=1, keepdims=True))


def add_scores(total: np.ndarray, rows: list[tuple[int, np.ndarray]], table: np.ndarray) -> None:
    """Add to each text's row the log probabilities of its n-grams: the sparse matrix of texts by n-grams, one entry an
    occurrence, times the dense one, CELLS products at a time."""
    rows = [(i, found) for i, found in rows if len(found)]
    step = max(1, CELLS // max(1, table.shape[1]))
    for i, found in rows:
        if len(found) > step:
            for a in range(0, len(found), step):
                total[i] += table[found[a : a + step]].sum(axis=0, dtype=np.float64)
    held: list[tuple[int, np.ndarray]] = []
    for i, found in [r for r in rows if len(r[1]) <= step] + [(-1, np.empty(0, np.int64))]:
        if held and (i < 0 or sum(len(f) for _, f in held) + len(found) > step):
            starts = np.cumsum([0, *(len(f) for _, f in held)])[:-1]
            np.add.at(total, [k for k, _ in held], np.add.reduceat(table[np.concatenate([f for _, f in held])], starts, axis=0, dtype=np.float64))
            held = []
        held.append((i, found))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of lang_pred) for every row of docs.

    und with score 0 where the text is null or has no letter, or where nothing was learnt. Ties go to the language that
    sorts first.
    """
    langs, prior, table = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, prior, np.ascontiguousarray(table.T.astype(np.float32))))

    def one(batch: pa.RecordBatch) -> dict:
        langs, prior, table = shared.value
        text = batch.column("text").to_pylist()
        total = np.zeros((len(text), len(langs)))
        known = [i for i, t in enumerate(text) if langs and HAS_LETTER.search(t)]
        rows: list[tuple[int, np.ndarray]] = []
        for i in known:
            total[i] += prior
            for found in sliced_ngrams(letters(text[i])):
                rows.append((i, found))
                if len(found) >= SLICE or len(rows) >= GROUP:
                    add_scores(total, rows, table)
                    rows = []
        add_scores(total, rows, table)
        names, scores = [UNKNOWN] * len(text), np.zeros(len(text))
        if known:
            own = total[known]
            best = own.argmax(axis=1)
            scores[known] = 1 / np.exp(np.minimum(own - own.max(axis=1, keepdims=True), 0)).sum(axis=1)
            for i, k in zip(known, best, strict=True):
                names[i] = langs[k]
        return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}

    return texts(docs).mapInArrow(batches(one, SCHEMA), RESULT)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, learning from rows outside the fold with a language."""
    labelled = texts(docs, F.col("lang").cast("string").alias("label")).filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    out = predict(docs, fit(labelled.select("text", "label")))
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
