"""A stored inverted index that is changed by deltas and read a few buckets at a time.

    folder/v-1/postings/bucket=K/   term, doc_id, tf, len of what version 1 has indexed, sorted by term
    folder/v-1/lengths/             doc_id, len
    folder/v-1/gone/                doc_id of documents whose older postings count no more
    folder/v-1/stats/               one row: documents, sum of lengths, versions that make up the index

A version is written whole and then becomes the index by one rename of a pointer. A delta adds a version and touches no
file of the ones before: a posting counts unless a later version says that its document is gone or changed. `compact`
makes one version of all. A query names its terms, so it opens their buckets alone, and a term that isn't in its bucket
is known to be nowhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import bm25_tokens
from quern.operators.search import K1, B
from quern.session import discard, materialize
from quern.sources.jsonl import point_to, published

#: Buckets of terms; a term's postings lie in SPREAD files of its bucket, as one term may be in a third of all rows.
BUCKETS, SPREAD = 64, 4
POSTINGS = "term string, doc_id long, tf long, len int, bucket int"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _live(spark: SparkSession, folder: str) -> tuple[str, dict]:
    """The published version and its row of statistics."""
    place = published(spark, folder)
    return place, spark.read.parquet(f"{place}/stats").first().asDict()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _lengths(spark: SparkSession, folder: str, versions: list[int]) -> DataFrame:
    """(doc_id, len) of documents that count: the last version that names one says whether it is there."""
    said = [spark.read.schema("doc_id long, len int").parquet(f"{folder}/v-{v}/lengths").select("doc_id", "len", F.lit(2 * v + 1).alias("v")) for v in versions]
    said += [spark.read.schema("doc_id long").parquet(f"{folder}/v-{v}/gone").select("doc_id", F.lit(None).cast("int").alias("len"), F.lit(2 * v).alias("v")) for v in versions]
    return _union(said).groupBy("doc_id").agg(F.max_by("len", "v").alias("len")).filter("len is not null")


def _write(folder: str, version: int, versions: list[int], gone: DataFrame, stats: tuple[int, int], buckets: int, lengths: DataFrame, postings: DataFrame) -> str:
    spark, place = gone.sparkSession, f"{folder}/v-{version}"
    dealt = postings.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "doc_id")
    dealt.write.partitionBy("bucket").parquet(f"{place}/postings")
    lengths.write.parquet(f"{place}/lengths")
    gone.select("doc_id").write.parquet(f"{place}/gone")
    spark.createDataFrame([(*stats, versions, buckets)], "n_docs long, total long, versions array<int>, buckets int").coalesce(1).write.parquet(f"{place}/stats")
    point_to(spark, folder, f"v-{version}")
    return place


def _cut(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings and lengths of documents, and the tokens that both are made from, written once. Rows are dealt before they
    are cut, as few row groups hold many texts. Ids are those of one row each; what repeats one is indexed beside it, a null id isn't."""
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    dealt = one.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text")
    tokens = materialize(dealt.select("doc_id", bm25_tokens("text").alias("tokens")), "index-tokens")
    counted = tokens.select("doc_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))
    return counted.withColumn("bucket", bucket_of(F.col("term"), buckets)), tokens.select("doc_id", F.size("tokens").alias("len")), tokens


def build(docs: DataFrame, folder: str, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write an index of docs as version 1 of a folder that has none."""
    postings, lengths, tokens = _cut(docs, buckets, id_col, text_col)
    total = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    place = _write(folder, 1, [1], docs.sparkSession.createDataFrame([], "doc_id long"), tuple(total), buckets, lengths, postings)
    discard(tokens)
    return place


def update(changed: DataFrame, deleted: DataFrame | None, folder: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Add a version with new and changed documents and without the deleted ones (doc_id). Nothing written before is touched."""
    spark = changed.sparkSession
    _, stats = _live(spark, folder)
    versions = list(stats["versions"])
    version = max(versions) + 1
    postings, lengths, tokens = _cut(changed, stats["buckets"], id_col, text_col)
    ids = changed.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null")
    if deleted is not None:
        ids = ids.unionByName(deleted.select(F.col("doc_id").cast("long").alias("doc_id")))
    old = _lengths(spark, folder, versions).join(ids.distinct(), "doc_id", "left_semi")
    less = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    more = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    now = (stats["n_docs"] - less[0] + more[0], stats["total"] - less[1] + more[1])
    place = _write(folder, version, [*versions, version], old, now, stats["buckets"], lengths, postings)
    discard(tokens)
    return place


def term_postings(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """(term, doc_id, tf, len) of the terms that count; only their buckets are opened."""
    _, stats = _live(spark, folder)
    terms, n = list(dict.fromkeys(terms)), stats["buckets"]
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), n)).distinct().collect()]
    read = lambda v: spark.read.schema(POSTINGS).parquet(f"{folder}/v-{v}/postings").filter(F.col("bucket").isin(*wanted) & F.col("term").isin(*terms)).select("term", "doc_id", "tf", "len", F.lit(v).alias("v"))
    found = _union([read(v) for v in stats["versions"]])
    if len(stats["versions"]) > 1:
        gone = _union([spark.read.schema("doc_id long").parquet(f"{folder}/v-{v}/gone").select("doc_id", F.lit(v).alias("gone_v")) for v in stats["versions"]])
        last = gone.groupBy("doc_id").agg(F.max("gone_v").alias("gone_v"))
        found = found.join(last, "doc_id", "left").filter("gone_v is null or v >= gone_v")
    return found.select("term", "doc_id", "tf", "len")


def absent(spark: SparkSession, folder: str, terms: list[str]) -> list[str]:
    """Terms that no document has, in their order."""
    known = {r["term"] for r in term_postings(spark, folder, terms).select("term").distinct().collect()}
    return [t for t in dict.fromkeys(terms) if t not in known]


def bm25(spark: SparkSession, folder: str, terms: list[str], required: list[str] = ()) -> DataFrame:
    """(doc_id, score) of documents with a term; a term that the query repeats counts as often. Where one of the required
    terms is in no document, nothing is searched further and the result is empty."""
    if required and absent(spark, folder, list(required)):
        return spark.createDataFrame([], "doc_id long, score double")
    _, stats = _live(spark, folder)
    hits = term_postings(spark, folder, terms)
    often = spark.createDataFrame([(t, float(terms.count(t))) for t in dict.fromkeys(terms)], "term string, often double")
    weights = F.broadcast(hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df")).join(F.broadcast(often), "term"))
    n, mean = float(stats["n_docs"]), stats["total"] / max(1, stats["n_docs"])
    tf = F.col("tf").cast("double")
    one = F.col("often") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / mean))
    return hits.join(weights, "term").groupBy("doc_id").agg(F.sum(one).alias("score"))


def compact(spark: SparkSession, folder: str) -> str:
    """One version of all that counts, as the next version; the ones before stay until they are deleted."""
    _, stats = _live(spark, folder)
    versions = stats["versions"]
    gone = _union([spark.read.schema("doc_id long").parquet(f"{folder}/v-{v}/gone").select("doc_id", F.lit(v).alias("gone_v")) for v in versions]).groupBy("doc_id").agg(F.max("gone_v").alias("gone_v"))
    found = _union([spark.read.schema(POSTINGS).parquet(f"{folder}/v-{v}/postings").withColumn("v", F.lit(v)) for v in versions])
    live = found.join(gone, "doc_id", "left").filter("gone_v is null or v >= gone_v").select("term", "doc_id", "tf", "len", "bucket")
    version = max(versions) + 1
    return _write(folder, version, [version], spark.createDataFrame([], "doc_id long"), (stats["n_docs"], stats["total"]), stats["buckets"], _lengths(spark, folder, versions), live)
