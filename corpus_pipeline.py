"""A training corpus from the documents table, in five stages.

Each stage is (name, function) and a function takes (spark, docs, sf_dir) and returns a DataFrame; what one stage keeps
is the next one's input. Rows are decided one by one: rows that share a doc_id but not the text are documents of their
own, and a null doc_id is an id that comes after all others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import lookup_join, read_table
from quern.llm.exact_dedup import first_rows
from quern.llm.lexicon import encode_decode
from quern.llm.mixing import mix
from quern.llm.near_copies import one_of_each
from quern.llm.quality import fit, grades_of, select
from quern.session import drop_scratch, expose_package, materialize, scratch_mark


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose best grade is probable enough, by the classifier fitted on the labels of docs. Narrow. Null and empty
    texts are texts without tokens; without labels of two grades every row stays."""
    return select(docs, fit(docs, grades_of(read_table(spark, sf_dir, "labels"))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest doc_id; null counts as empty. Of rows that repeat
    id and text one stays."""
    return first_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each component of near copies (Jaccard of five-word shingles >= 0.8), the one with the smallest doc_id.
    Candidates come from SimHash fingerprints by vantage-point trees; copies that near lie on average ten bits apart in a
    fingerprint of 64, where trees prune nothing, so those that minhash bands find are added. Texts without a word are
    alike."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in mixture order: partitions are consecutive ranges of positions, sorted, so that the files written from
    them hold the order by name and row. Rows that share a doc_id lie side by side; a null source is a source."""
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("key")
    places = materialize(mix(docs).groupBy(key).agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("n")), "mixture-places")
    most, total = places.agg(F.max("position"), F.sum("n")).first()
    most = most or 0
    placed = lookup_join(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key), places, ["key"], "n", total or 0, shuffled=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionById(parts, F.expr(f"int(position * {parts} div {most + 1})")).sortWithinPartitions("position")
    return dealt.select("row.*")


def written_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and position, a row's number in the files that docs was read from, by file name and row; of rows that come from no files, by
    partition and row."""
    try:
        named = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("at"))
        named = numbered.select("doc_id", "text", F.format_string("%012d", F.shiftright("at", 33)).alias("file"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    at, before = 0, []
    # one row for each file, of which a stage writes one a partition
    for r in sorted(named.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((r["file"], at))
        at += r["n"]
    table = docs.sparkSession.createDataFrame(before, "file string, before long")
    return named.join(F.broadcast(table), "file").select("doc_id", "text", (F.col("before") + F.col("row")).alias("position"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of what is left, as digests, with each row's position in the mixture."""
    return encode_decode(written_order(docs), public_tokenizers.path("word_bpe_49k.json"), position=F.col("position"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixture), ("bpe", tokens)]

#: Of the stages, exact dedup alone can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each reading what the one before has written. A stage's scratch tables are deleted
    when its rows are written; those of the last stage stay until drop_scratch, as the result reads them."""
    expose_package(spark)
    docs, begin = read_table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_scratch(spark, begin, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
