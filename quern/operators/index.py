"""Indexes as tables: postings, corpus statistics, symbols and literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import bm25_tokens
from quern.session import materialize


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(term, doc_id, tf), one row for each term of a document."""
    words = tokens if tokens is not None else bm25_tokens(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(words).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.size(bm25_tokens(text_col)).alias("len"))


def query_postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, len, tf_0, tf_1, ...): length and counts of the query's distinct terms, for every document.

    For a query the whole inverted index isn't needed: each text is cut into tokens once, where it is read, tokens of the
    query are kept, and counts are taken from those in the same row. Nothing is exploded or shuffled; the result, a few
    numbers a document, is written once, as both the corpus's statistics and the scores are made from it.
    """
    terms = list(dict.fromkeys(terms))
    cut = docs.select(F.col(id_col).alias("doc_id"), bm25_tokens(text_col).alias("tokens"))
    kept = cut.select("doc_id", F.size("tokens").alias("len"), F.filter("tokens", lambda t: t.isin(*terms)).alias("hits"))
    counts = (F.size(F.filter("hits", F.lit(w).eqNullSafe)).alias(f"tf_{i}") for i, w in enumerate(terms))
    return materialize(kept.select("doc_id", "len", *counts), "query-postings")


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): documents with each term."""
    counted = docs.select(F.explode(F.array_distinct(bm25_tokens(text_col))).alias("term"))
    return counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def exact_index(docs: DataFrame, keys: list[Column], id_col: str = "doc_id") -> DataFrame:
    """(key, doc_id) of each key column, in lower case, blank keys left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(F.array(*(F.lower(F.trim(k)) for k in keys)))).alias("key")).filter("key <> ''")


def symbol_map(names: DataFrame, name: str, id_col: str) -> DataFrame:
    """(symbol, id): the upper-case name and its bare tokens of three letters or more."""
    upper = F.upper(F.trim(name))
    parts = F.filter(F.split(upper, "[^A-Z0-9]+"), lambda p: F.length(p) >= 3)
    return names.select(F.explode(F.array_distinct(F.concat(F.array(upper), parts))).alias("symbol"), F.col(id_col).alias("id")).filter("symbol <> ''").distinct()


def capped_postings(rows: DataFrame, key: str, id_col: str, cap: int) -> DataFrame:
    """(key, ids, n): the first cap ids of each key by id, and the count of all. Ranks are cut at the cap before ids are
    gathered, so no key's ids are ever in one row; the count is an aggregate of its own."""
    pairs = rows.select(key, id_col).distinct()
    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(id_col))).filter(F.col("_r") <= cap)
    lists = first.groupBy(key).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    return lists.join(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def values_by_field(literals: DataFrame, most: int) -> DataFrame:
    """(field, value, n) for fields with at most so many distinct values."""
    counts = literals.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counts.groupBy("field").agg(F.count(F.lit(1)).alias("n_values")).filter(F.col("n_values") <= most).select("field")
    return counts.join(few, "field", "left_semi")
