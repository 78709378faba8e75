"""Compression of vectors into codes of their parts (product quantisation), in whole numbers.

Components are floor(4096 x). Each of PARTS parts has a codebook of ENTRIES entries, refined by rounds of assignment and
component-wise floor of means, so every result is exact and doesn't depend on the order of rows or on partitions.

Assignment: |x - c|^2 = |x|^2 + |c|^2 - 2 xc, where one float32 matrix product gives xc for a batch and all entries. Its
rounding error is at most GAMMA |x||c| (see `nearest`), so each entry's distance lies in an interval. Entries whose interval
overlaps the one of the best are evaluated again in int64 and ties go to the lower index.

A round is one pass over the table: tasks send sums and counts of each entry, which Spark adds up, and the driver holds
codebooks alone: ENTRIES times the vector's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, expose_package, int64, lookup_join, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Whole components up to here have squared distances that int64 adds up for parts of up to 1,024 components.
LARGEST = 1 << 25
#: Rows whose distances are held at a time.
ROWS = 1 << 14
UNIT = 2.0**-24
Codebooks = list[np.ndarray]


class Unfit(PySparkValueError):
    """Vectors that can't be cut or counted as this operator does."""


def whole_vectors(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is kept, and floor(scale x) of their components. Dropped are null vectors and ones with a null,
    infinite or undefined component. Vectors of different lengths, and components beyond LARGEST, raise Unfit."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths()
    there = np.flatnonzero(lengths.is_valid().to_numpy(zero_copy_only=False))
    if not len(there):
        return there, np.zeros((0, 0), np.int64)
    flat, size = column.flatten(), lengths.drop_null().to_numpy()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.zeros(len(there), np.int64)
    np.add.at(bad, np.repeat(np.arange(len(there)), size), ~np.isfinite(values))
    good = bad == 0
    if not good.any():
        return there[good], np.zeros((0, 0), np.int64)
    if len(set(size[good].tolist())) > 1:
        raise Unfit("vectors differ in length")
    wholes = np.floor(values[np.repeat(good, size)] * float(scale))
    if len(wholes) and np.abs(wholes).max() > LARGEST:
        raise Unfit(f"a component is beyond {LARGEST / scale:g}")
    return there[good], wholes.astype(np.int64).reshape(good.sum(), -1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry to each row, ties to the lower one, its squared distance, and how many distances were
    evaluated again.

    Whole numbers up to 2^24 are exact in float32, larger ones are rounded once (relative error UNIT each, so at most
    2 UNIT + UNIT^2 of a product). A sum of m products in any order, fused or not, is off by at most m UNIT / (1 - m UNIT)
    times the sum of their absolute values, which is at most |x||c|. What float64 adds is far below the margin of one
    more UNIT.
    """
    m, k = x.shape[1], len(book)
    if k == 0 or len(x) == 0:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    gamma = (m + 4) * UNIT / (1 - (m + 4) * UNIT)
    products = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    squares = (book * book).sum(axis=1)
    radius = 2 * gamma * np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares.astype(np.float64))[None, :] + 1e-6
    middle = squares[None, :] - 2 * products
    may = middle - radius <= (middle + radius).min(axis=1)[:, None]
    best = may.argmax(axis=1)
    row, entry = np.nonzero(may & (may.sum(axis=1) > 1)[:, None])
    if len(row):
        off = x[row] - book[entry]
        exact = np.full(may.shape, np.iinfo(np.int64).max)
        exact[row, entry] = (off * off).sum(axis=1)
        again = np.unique(row)
        best[again] = exact[again].argmin(axis=1)  # the first of equal ones
    off = x - book[best]
    return best, (off * off).sum(axis=1), len(row)


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    if x.shape[1] % parts:
        raise Unfit(f"{x.shape[1]} components can't be cut in {parts} equal parts")
    return np.split(x, parts, axis=1) if len(x) else []


def slices(batch: pa.RecordBatch, scale: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """whole_vectors of ROWS rows at a time; the length must be that of the codebooks."""
    for a in range(0, batch.num_rows, ROWS):
        rows, x = whole_vectors(batch.slice(a, ROWS).column("vector"), scale)
        if len(rows):
            if x.shape[1] != length:
                raise Unfit("vectors differ in length")
            yield rows + a, x


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the kept vectors with the smallest vec_ids, ascending; equal ids go by their components, null ids are
    none. Fewer kept vectors give fewer entries."""
    kept = vectors.filter("vec_id is not null and vector is not null").filter(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    first = kept.orderBy("vec_id", "vector").limit(entries).toArrow()
    _, x = whole_vectors(first.column("vector"), scale)
    return [b.copy() for b in cut(x, parts)]


def entry_sums(vectors: DataFrame, books: Codebooks, parts: int, scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): how many parts it is nearest to, and their sum. One row of each entry from each task."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    width, k = books[0].shape[1], len(books[0])
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("total", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in source:
            for _, x in slices(batch, scale, parts * width):
                for p, own in enumerate(cut(x, parts)):
                    best, _, _ = nearest(own, shared.value[p])
                    n[p] += np.bincount(best, minlength=k)
                    np.add.at(total[p], best, own)
        p, e = np.nonzero(n)
        flat = np.repeat(np.arange(len(p)), width)
        yield pa.RecordBatch.from_arrays([pa.array(p[flat], pa.int32()), pa.array(e[flat], pa.int32()), pa.array(n[p, e][flat]), pa.array(np.tile(np.arange(width), len(p)), pa.int32()), pa.array(total[p, e].reshape(-1))], schema=schema)

    sums = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, at int, total long")
    rows = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a codebook's numbers
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(rows):
        found.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(r["total"])
    return found


def fit_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of (vec_id, vector) after the rounds; an empty list where no vector is kept."""
    books = first_books(vectors, parts, entries, scale)
    for _ in range(rounds if books and books[0].shape[1] else 0):
        for (p, e), (n, total) in entry_sums(vectors, books, parts, scale).items():
            books[p][e] = [t // n for t in total]
    return books


def digest_of(books: Codebooks) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code and error of every kept row of (vec_id, embedding, label), label_error and codebooks_sha256.

    code is the index of each part's entry, two hexadecimal digits each; error the sum of squared distances; label_error
    the errors of all rows of equal label, null ones together. Dropped are null vectors and vectors with null or
    non-finite components. Equal vectors have equal codes; rows that repeat a vec_id are rows of their own; a null vec_id
    stays. An empty table, or one of which nothing is kept, gives an empty result. Vectors without components have error
    0. Kept vectors of different lengths, of a length that `parts` doesn't divide, or with components beyond 8,192 raise
    an error.
    """
    spark = vectors.sparkSession
    expose_package(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    books = fit_books(rows, parts, entries, rounds, scale)
    shared, length = spark.sparkContext.broadcast(books), sum(b.shape[1] for b in books)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.Table:
        found = []
        for kept, x in slices(batch, scale, length):
            pairs = [nearest(own, book) for own, book in zip(cut(x, parts), shared.value, strict=True)]
            codes = np.stack([best for best, _, _ in pairs], axis=1).astype(np.uint8)
            rows = batch.select(["vec_id", "label"]).take(pa.array(kept))
            found.append(pa.RecordBatch.from_arrays([*rows.columns, pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(error for _, error, _ in pairs))], schema=schema))
        return pa.Table.from_batches(found, schema).combine_chunks().to_batches()[0] if found else pa.RecordBatch.from_pylist([], schema)

    coded = materialize(rows.mapInArrow(batches(one), "vec_id long, label string, code string, error long"), "vector-codes")
    keyed = coded.select("vec_id", "label", "code", "error", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("of"))
    sums = keyed.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return lookup_join(keyed, sums, ["of"], "n", coded.count()).select("vec_id", "label", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
