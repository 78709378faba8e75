"""The pipeline on a small table against plain versions of what its stages decide."""

import os

import pytest
from oracle_llm import DATA, near_components, same_texts

from quern.session import _scratch, drop_scratch, materialize, scratch_mark

import corpus_pipeline as C
from quern.llm.mixing import mix


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in C.STAGES:
        before = docs
        docs = stage(spark, docs, DATA).cache()
        out.append((before, docs))
    return out


def written(spark, docs, tmp_path, name):
    docs.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_each_stage_keeps_columns_and_decides(spark, stages):
    columns = stages[0][0].columns
    assert [n for n, _ in C.STAGES] == ["quality", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    assert all(after.columns == columns for _, after in stages[:-1])
    quality, exact, near, mixed, tokens = ((a.collect(), b.collect()) for a, b in stages)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality[1]}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) / len(clean) > 0.95 and len(quality[1]) < len(quality[0])
    assert {r.doc_id for r in exact[1]} == same_texts(exact[0])
    assert {r.doc_id for r in near[1]} == near_components(near[0])
    assert sorted(mixed[0]) == sorted(mixed[1])
    assert sorted(r.doc_id for r in tokens[1]) == sorted(r.doc_id for r in tokens[0])


def test_run_equals_stages(spark, stages):
    got, want = C.run(spark, DATA).collect(), stages[-1][1].collect()
    assert sorted(r[:4] for r in got) == sorted(r[:4] for r in want)
    # the mixture's order reaches the result
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.position)]
    places = {r.doc_id: r.position for r in mix(stages[3][0]).collect()}
    assert ids == sorted(places, key=places.get) and [r.position for r in sorted(got, key=lambda r: r.position)] == list(range(len(got)))
    assert drop_scratch(spark) > 0


def test_scratch_tables_go_but_for_what_is_read(spark):
    mark = scratch_mark()
    one, two = (materialize(spark.range(n), "x") for n in (3, 4))
    assert drop_scratch(spark, mark, but=two) == 1 and two.count() == 4 and len(_scratch) == mark + 1
    assert drop_scratch(spark, mark) == 1


ODD = [
    (1, None, "x", "a"), (2, "", "x", "a"), (3, "one two three four five six", "x", None), (3, "one  two three four five six", "x", "b"), (3, "another text under the same id", "x", "b"),
    (4, "one two three four five six", "x", "b"), (None, "one two three four five six", "x", "b"), (None, "only null ids have this text here", "y", "b"), (None, "only null ids have this text here", "y", "b"),
    (5, "again and again the very same row", "y", "c"), (5, "again and again the very same row", "y", "c"), (6, "w" * 200_000 + " " + "long text " * 30_000, "y", "c"),
]


def odd(spark, rows=ODD):
    """Rows with extra columns whose names the operators use themselves."""
    rows = [(i, t, s, "en", k, 0, "p", [1]) for k, (i, t, s, _) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, key int, position int, row string, bands array<int>").repartition(3)


def texts_of(df):
    return sorted((str(r.doc_id), (r.text or "")[:40]) for r in df.collect())


def test_exact_decides_by_row(spark):
    docs = odd(spark)
    got = C.exact(spark, docs, DATA)
    assert got.columns == docs.columns
    want = [(1, ""), (3, "one two three four five six"), (3, "another text under the same id"), (None, "only null ids have this text here"), (5, "again and again the very same row"), (6, "w" * 40)]
    # 3 and 3: one of the rows that share id and normalised text
    assert [(i, " ".join(t.split())) for i, t in texts_of(got)] == sorted((str(i), t) for i, t in want)


def test_near_decides_by_row(spark):
    got = C.near(spark, odd(spark), DATA)
    assert got.columns == odd(spark).columns
    kept = [(i, " ".join(t.split())) for i, t in texts_of(got)]
    # texts without a word are alike; id 3 keeps one of two texts that differ by a blank and its other text
    want = [(1, ""), (3, "one two three four five six"), (3, "another text under the same id"), (None, "only null ids have this text here"), (None, "only null ids have this text here"), (5, "again and again the very same row"), (5, "again and again the very same row"), (6, "w" * 40)]
    assert kept == sorted((str(i), t) for i, t in want)


def test_quality_mixture_and_tokens_keep_rows(spark, tmp_path):
    docs = odd(spark)
    assert C.quality(spark, docs, DATA).columns == docs.columns
    mixed = written(spark, C.mixture(spark, docs, DATA), tmp_path, "mixed")
    assert mixed.columns == docs.columns and texts_of(mixed) == texts_of(docs)
    out = C.tokens(spark, mixed, DATA).collect()
    assert sorted(r.position for r in out) == list(range(len(ODD))) and sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ODD)
    assert len(C.tokens(spark, docs, DATA).collect()) == len(ODD)


@pytest.mark.parametrize("stage", range(5))
def test_empty_tables(spark, stage):
    assert C.STAGES[stage][1](spark, odd(spark).filter("false"), DATA).count() == 0


def test_registered(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in found
    assert os.path.exists(os.path.join(os.path.dirname(__spark_entry__.__file__), "corpus_pipeline.py"))
