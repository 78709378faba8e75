"""Retrieval plans: channels combined, fused, gated and evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.fuse import reciprocal_rank_fusion
from quern.operators.index import query_postings
from quern.operators.search import VECTOR_LEAST, bm25_scores, cosine, exact_hits, hybrid_score, lexical_score, metadata_score, term_coverage, tfidf_scores, top_k, trigram_overlap


def ranked_lists(docs: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(list, doc_id, rank, score) of the BM25 and tf-idf lists."""
    out, found = None, query_postings(docs, terms)
    for name, scores in (("bm25", bm25_scores(docs, terms, found=found)), ("tfidf", tfidf_scores(docs, terms, found=found))):
        part = top_k(scores, k).select(F.lit(name).alias("list"), "doc_id", F.col("rank").cast("long").alias("rank"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def hybrid(docs: DataFrame, confidence: DataFrame, terms: list[str], k: int, vectors: DataFrame | None = None, query: list[float] | None = None) -> DataFrame:
    """The k best documents by exact fields, tf-idf, vectors, metadata and confidence (doc_id, confidence, one row a
    document). vectors: (doc_id, embedding), compared with the query's; less than VECTOR_LEAST is no hit.

    Candidates are documents with any channel above 0. Confidence is joined to candidates alone.
    """
    meta = docs.select("doc_id", exact_hits([F.col("source"), F.col("lang")], terms).alias("exact"), metadata_score([F.col("source"), F.col("lang")], terms).alias("meta")).filter("exact > 0 or meta > 0")
    scores = tfidf_scores(docs, terms).withColumnRenamed("score", "fulltext")
    found = scores.join(meta, "doc_id", "full_outer")
    if vectors is None or query is None:
        found = found.withColumn("vector", F.lit(0.0))
    else:
        close = vectors.select("doc_id", cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))).alias("vector")).filter(F.col("vector") >= VECTOR_LEAST)
        found = found.join(close, "doc_id", "full_outer")
    found = found.join(confidence, "doc_id", "left")
    total = hybrid_score(F.col("exact"), F.col("fulltext"), F.col("vector"), F.col("meta"), F.col("confidence"))
    return top_k(found.select("doc_id", total.alias("score")), k)


def lexical(docs: DataFrame, terms: list[str], phrase: str, k: int) -> DataFrame:
    """The k best documents by additive boosts: phrase, all terms, terms, trigrams of the first term, BM25."""
    marks = docs.select("doc_id", F.contains(F.lower("text"), F.lit(phrase.lower())).alias("has_phrase"), term_coverage("text", terms).alias("n_terms"), trigram_overlap(F.col("text"), terms[0]).alias("overlap"))
    found = marks.filter("has_phrase or n_terms > 0").join(bm25_scores(docs, terms).withColumnRenamed("score", "bm25"), "doc_id", "left")
    score = lexical_score(F.col("has_phrase"), F.col("n_terms") == len(set(terms)), F.col("n_terms"), F.col("overlap"), F.coalesce("bm25", F.lit(0.0)), F.lit(0.0))
    return top_k(found.select("doc_id", score.alias("score")), k)


def fused(docs: DataFrame, terms: list[str], k: int, each: int = 50) -> DataFrame:
    return top_k(reciprocal_rank_fusion(ranked_lists(docs, terms, each)), k, score="rrf")
