import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PythonException

from quern.llm import vector_codes as V


def plain(rows):
    kept = [(i, label, [math.floor(4096 * float(x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    w = len(kept[0][2]) // 8
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2]))[:16]
    books = [[r[2][p * w : p * w + w] for r in first] for p in range(8)]

    def best(p, x):
        own = [(sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])]
        return min(own)

    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, _, v in kept:
                x = v[p * w : p * w + w]
                groups.setdefault(best(p, x)[1], []).append(x)
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, label, v in kept:
        found = [best(p, v[p * w : p * w + w]) for p in range(8)]
        out.append([i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)])
    total = {}
    for r in out:
        total[r[1]] = total.get(r[1], 0) + r[3]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), str(label), c, e, total[label]) for i, label, c, e in out), digest


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, error string").repartition(4)


def compare(spark, rows):
    got = V.compress(table(spark, rows)).collect()
    want, digest = plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert sorted((str(r.vec_id), str(r.label), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} <= {digest}


def test_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist(), int(rng.integers(0, 4)) if i % 5 else None) for i in range(5, 150)]
    coarse = [(i, (rng.integers(-2, 3, 16) / 4096).tolist(), 7) for i in range(200, 320)]  # many ties
    odd = [(1, None, 1), (2, [None] * 16, 1), (3, [0.1] * 15 + [float("nan")], 1), (4, [0.1] * 15 + [float("-inf")], 2), (None, [0.5] * 16, None), (0, [0.25] * 16, 9), (0, [-0.25] * 16, 9), (0, [0.25] * 16, 9)]
    compare(spark, rows + coarse + odd)


def test_large_components_and_few_rows(spark):
    compare(spark, [(i, [float((-1) ** (i + k) * 8000.123 / (1 + i * k % 7)) for k in range(16)], i % 2) for i in range(40)])
    compare(spark, [(5, [0.5] * 8, 1), (4, [-0.5] * 8, None)])
    compare(spark, [(5, [], 1)])
    compare(spark, [(5, None, 1)])


def test_intervals_hold_the_exact_best():
    rng = np.random.default_rng(11)
    again = 0
    for scale in (3, 300, 1 << 24, 1 << 25):
        x, book = (rng.integers(-scale, scale + 1, (n, 8)) for n in (4000, 16))
        book[5] = book[2]  # equal entries: the lower one
        x[:500] = book[rng.integers(0, 16, 500)] + rng.integers(-1, 2, (500, 8))
        x[500:900] = (book[3] + book[9]) // 2 + rng.integers(-1, 2, (400, 8))  # about as far from two
        best, error, n = V.nearest(x, book)
        exact = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (best == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
        again += n
    assert again > 1000


def test_few_rows_are_evaluated_again():
    rng = np.random.default_rng(12)
    x, book = np.floor(rng.normal(size=(20_000, 8)) * 500).astype(np.int64), np.floor(rng.normal(size=(16, 8)) * 500).astype(np.int64)
    assert V.nearest(x, book)[2] < 200


def test_refused(spark):
    for rows in ([(1, [0.1] * 8, 1), (2, [0.1] * 16, 1)], [(1, [0.1] * 9, 1)], [(i, [1e9] * 8, 1) for i in range(20)]):
        with pytest.raises((V.Unfit, PythonException)):
            V.compress(table(spark, rows)).collect()


def test_given_table_and_empty_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(spark, [(r.vec_id, r.embedding, r.label) for r in vectors.collect()])
    assert V.compress(vectors.limit(0)).count() == 0
