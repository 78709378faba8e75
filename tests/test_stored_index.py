import os
import random
import re

from pyspark.sql import functions as F

from quern.operators import search, stored_index

WORDS = "alpha beta gamma delta epsilon zeta eta theta größe straße x1 y_2".split()


def corpus(rng, ids):
    return {i: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30))) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def scores(df):
    return {r.doc_id: round(r.score, 9) for r in df.collect()}


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.startswith((".", "_")) and f.endswith(".parquet")}


def test_deltas_equal_a_new_index(spark, tmp_path):
    rng, folder = random.Random(2), f"file://{tmp_path}/index"
    docs = corpus(rng, range(60))
    stored_index.build(frame(spark, docs), folder, buckets=8)
    terms = ["alpha", "groesse", "y_2", "alpha", "nowhere"]
    assert scores(stored_index.bm25(spark, folder, terms)) == scores(search.bm25_scores(frame(spark, docs), terms))
    for step in range(3):
        before = files(tmp_path)
        changed, gone = corpus(rng, rng.sample(range(80), 15)), rng.sample(sorted(docs), 5)
        gone = [i for i in gone if i not in changed] + [999]
        stored_index.update(frame(spark, changed), spark.createDataFrame([(i,) for i in gone], "doc_id long"), folder)
        docs = {i: t for i, t in (docs | changed).items() if i not in gone}
        assert before <= files(tmp_path)
        assert scores(stored_index.bm25(spark, folder, terms)) == scores(search.bm25_scores(frame(spark, docs), terms)), step
    # what was deleted comes back
    back = corpus(rng, [gone[0]])
    stored_index.update(frame(spark, back), None, folder)
    docs |= back
    want = scores(search.bm25_scores(frame(spark, docs), terms))
    assert scores(stored_index.bm25(spark, folder, terms)) == want
    stored_index.compact(spark, folder)
    assert scores(stored_index.bm25(spark, folder, terms)) == want


def test_only_buckets_of_the_terms_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    stored_index.build(frame(spark, corpus(random.Random(3), range(200))), folder)
    found = stored_index.term_postings(spark, folder, ["alpha"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,alpha\)", plan)
    held = [f for f in files(tmp_path) if "postings" in f]
    own = {r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len({n.split("bucket=")[1].split("/")[0] for n in own}) == 1 and len({n.split("bucket=")[1].split("/")[0] for n in held}) >= 8
    assert stored_index.absent(spark, folder, ["nowhere", "alpha", "nix"]) == ["nowhere", "nix"]
    assert stored_index.bm25(spark, folder, ["alpha"], required=["alpha", "nix"]).count() == 0 < stored_index.bm25(spark, folder, ["alpha"], required=["beta"]).count()


def test_odd_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(None, "alpha"), (1, None), (2, ""), (3, "alpha alpha"), (4, "beta")], "doc_id long, text string")
    stored_index.build(rows, folder)
    assert [(r.doc_id, r.tf) for r in stored_index.term_postings(spark, folder, ["alpha", "beta"]).orderBy("doc_id").collect()] == [(3, 2), (4, 1)]
    empty = f"file://{tmp_path}/empty"
    stored_index.build(rows.limit(0), empty)
    assert stored_index.bm25(spark, empty, ["alpha"]).count() == 0
    stored_index.update(rows.filter("doc_id = 3"), None, empty)
    assert stored_index.bm25(spark, empty, ["alpha"]).count() == 1


def test_a_text_is_cut_once(spark, tmp_path):
    """However many tables of a version are made of it, and in as many tasks as there are partitions of a shuffle."""
    folder, seen = f"file://{tmp_path}/index", spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    docs = frame(spark, corpus(random.Random(5), range(50))).withColumn("text", F.udf(read, "string")("text"))
    stored_index.build(docs, folder, buckets=4)
    assert seen.value == 50
    stored_index.update(docs.filter("doc_id < 20"), None, folder)
    assert seen.value == 70
