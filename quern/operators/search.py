"""Scoring and retrieval: BM25, tf-idf, metadata, vectors, hybrid and lexical scores.

Every ranking ends with the document's id, so equal scores have one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import bm25_tokens, search_key
from quern.operators.index import query_postings

K1, B = 1.2, 0.75
# Weights of the hybrid score.
W_EXACT, W_FULLTEXT, W_VECTOR, W_METADATA, W_CONFIDENCE = 4.0, 1.2, 3.0, 1.0, 0.5
VECTOR_LEAST = 0.15


def top_k(scored: DataFrame, k: int, score: str = "score", id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """The k best rows with rank. Each task keeps k rows before they meet; ranks are given to those k alone."""
    best = scored.orderBy(F.round(score, digits).desc(), F.col(id_col)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.round(score, digits).desc(), F.col(id_col))))


def with_statistics(found: DataFrame, n_terms: int) -> DataFrame:
    """Documents of query_postings() with one of the terms, and beside each the corpus's one row of statistics: documents,
    mean length, and the document frequency of each term."""
    has = [F.col(f"tf_{i}") > 0 for i in range(n_terms)]
    stats = found.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), *(F.count_if(h).alias(f"df_{i}") for i, h in enumerate(has)))
    anywhere = F.greatest(*(F.col(f"tf_{i}") for i in range(n_terms)), F.lit(0)) > 0
    return found.filter(anywhere).crossJoin(F.broadcast(stats))


def bm25_scores(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of documents with a term; a term that the query repeats counts as often. found: the query's
    postings, where they are known already."""
    distinct = list(dict.fromkeys(terms))
    joined = with_statistics(found if found is not None else query_postings(docs, distinct, id_col, text_col), len(distinct))
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        tf, df = F.col(f"tf_{i}").cast("double"), F.col(f"df_{i}").cast("double")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        score = score + F.lit(float(terms.count(t))) * idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return joined.select("doc_id", score.alias("score"))


def tfidf_scores(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): sum of (1 + ln(1 + tf)) * ln(1 + N / df) over distinct terms."""
    terms = list(dict.fromkeys(terms))
    joined = with_statistics(found if found is not None else query_postings(docs, terms, id_col, text_col), len(terms))
    score = F.lit(0.0)
    for i in range(len(terms)):
        one = (1 + F.log(1 + F.col(f"tf_{i}").cast("double"))) * F.log(1 + F.col("n_docs") / F.col(f"df_{i}"))
        score = score + F.when(F.col(f"tf_{i}") > 0, one).otherwise(0.0)
    return joined.select("doc_id", score.alias("score"))


def metadata_score(fields: list[Column], terms: list[str]) -> Column:
    """Half a point for each term that the joined fields contain."""
    text = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(0.0)
    for t in dict.fromkeys(terms):
        out = out + F.when(F.contains(text, F.lit(t.lower())), 0.5).otherwise(0.0)
    return out


def exact_hits(fields: list[Column], terms: list[str]) -> Column:
    """Terms that equal a field."""
    out = F.lit(0.0)
    for t in dict.fromkeys(terms):
        same = F.lit(False)
        for f in fields:
            same = same | F.coalesce(F.lower(f) == t.lower(), F.lit(False))
        out = out + F.when(same, 1.0).otherwise(0.0)
    return out


def hybrid_score(exact: Column, fulltext: Column, vector: Column, metadata: Column, confidence: Column, boost: Column | float = 0.0) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    boost = boost if isinstance(boost, Column) else F.lit(float(boost))
    return W_EXACT * zero(exact) + W_FULLTEXT * zero(fulltext) + W_VECTOR * zero(vector) + W_METADATA * zero(metadata) + W_CONFIDENCE * zero(confidence) + boost


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without norm."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot / both).otherwise(0.0)


def cosine_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", least: float = VECTOR_LEAST) -> DataFrame:
    """The k vectors closest to the query with similarity of at least `least`. The query is a literal; the scan is narrow."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(F.col(id_col), cosine(F.col(vector_col), q).alias("score")).filter(F.col("score") >= least)
    return top_k(scored, k, id_col=id_col)


def phrase_hits(docs: DataFrame, phrases: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, phrase): the first phrase of the list that the folded text contains."""
    text = search_key(text_col)
    first = F.coalesce(*(F.when(F.contains(text, search_key(F.lit(p))), F.lit(p)) for p in phrases))
    return docs.select(F.col(id_col).alias("doc_id"), first.alias("phrase")).filter("phrase is not null")


def trigram_overlap(a: Column, needle: str) -> Column:
    """Share of the needle's trigrams that the text's letters and digits hold; the text's own trigrams aren't built."""
    bare = "".join(c for c in needle.upper() if c.isascii() and c.isalnum())
    want = sorted({bare[i : i + 3] for i in range(len(bare) - 2)})
    text = F.regexp_replace(F.upper(F.coalesce(a, F.lit(""))), "[^A-Z0-9]", "")
    hits = sum((F.contains(text, F.lit(g)).cast("int") for g in want), F.lit(0))
    return hits / len(want) if want else F.lit(0.0)


def lexical_score(phrase: Column, all_terms: Column, n_terms: Column, trigram: Column, bm25: Column, kind_boost: Column) -> Column:
    """Additive boosts of the lexical channel."""
    return F.when(phrase, 120.0).otherwise(0.0) + F.when(all_terms, 70.0).otherwise(0.0) + 12.0 * n_terms + F.when(trigram >= 0.6, 35.0).otherwise(0.0) + F.least(F.lit(40.0), 6.0 * bm25) + kind_boost


# Boosts of the lexical channel by field, and of what a whole query has in common with a document.
PHRASE_BOOSTS = {"field_text": 120, "table_text": 110, "data_element_text": 105, "search_text": 90, "title": 90}
TECHNICAL_BOOST, ALL_TERMS_BOOST, DESCRIPTION_BOOST, CODE_BOOST, TERM_BOOST = 100, 70, 45, 28, 12
DESCRIBING = ("field_text", "table_text", "data_element_text", "domain_text")


def field_boosts(fields: dict[str, Column], technical: list[str], phrases: list[str], terms: list[str]) -> Column:
    """The field-wise part of a lexical score. fields: technical_name, title, code_summary and the texts of PHRASE_BOOSTS and
    DESCRIBING; those that a document hasn't are left out.

    A technical token of three letters that the name holds counts once. Of the phrases of five letters the first that
    any field holds counts, by the first field that does. Terms of three letters count as one where all of several are
    found, else each; where one is in a describing text that counts too, and otherwise one in the summary of code.
    """
    plain = {k: search_key(c) for k, c in fields.items()}
    holds = lambda name, what: F.contains(plain[name], search_key(F.lit(what))) if name in plain else F.lit(False)
    anywhere = lambda names, words: F.greatest(F.lit(False), F.lit(False), *(holds(n, w) for n in names for w in words))
    name = F.upper(F.coalesce(fields.get("technical_name", F.lit(None).cast("string")), F.lit("")))
    exact = F.greatest(F.lit(False), F.lit(False), *(F.contains(name, F.lit(t)) for t in technical if len(t) >= 3))
    boosts = [F.when(holds(field, p), F.lit(b)) for p in phrases if len(p) >= 5 for field, b in PHRASE_BOOSTS.items()]
    words = [t for t in terms if len(t) >= 3]
    found = [anywhere(plain, [t]) for t in words]
    n = sum((f.cast("int") for f in found), F.lit(0))
    described = F.greatest(F.lit(False), F.lit(False), *(f & anywhere(DESCRIBING, [t]) for t, f in zip(words, found, strict=True)))
    in_code = F.greatest(F.lit(False), F.lit(False), *(f & anywhere(("code_summary",), [t]) for t, f in zip(words, found, strict=True)))
    shared = F.when((n == len(words)) & (n >= 2), ALL_TERMS_BOOST).otherwise(n * TERM_BOOST)
    return F.when(exact, TECHNICAL_BOOST).otherwise(0) + F.coalesce(*boosts, F.lit(0)) + shared + F.when(described, DESCRIPTION_BOOST).when(in_code, CODE_BOOST).otherwise(0)


def term_coverage(text_col: str, terms: list[str]) -> Column:
    """Distinct terms that a text's tokens contain."""
    return F.size(F.array_intersect(bm25_tokens(text_col), F.array(*map(F.lit, terms))))


def expand_relations(seeds: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, boost): the best `most` seeds push clamp(0.08 * score, 0.8, 2.5) to the targets of their edges."""
    best = F.broadcast(top_k(seeds, most).select(F.col("doc_id").alias("from_id"), "score"))
    pushed = edges.join(best, "from_id").select(F.col("to_id").alias("doc_id"), F.greatest(F.lit(0.8), F.least(F.lit(2.5), 0.08 * F.col("score"))).alias("boost"))
    return pushed.groupBy("doc_id").agg(F.sum("boost").alias("boost"))
