"""Gates, grounding and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_filter(kind: Column, allowed: list[str], forced: Column) -> Column:
    """Kinds of the list, and rows that a symbol forces in."""
    return F.coalesce(kind.isin(*allowed), F.lit(False)) | F.coalesce(forced, F.lit(False))


def metadata_filter(metadata: Column, wanted: dict[str, str]) -> Column:
    """All wanted values that aren't blank are there, compared as text; a missing key rejects."""
    out = F.lit(True)
    for k, v in wanted.items():
        if str(v).strip():
            out = out & F.coalesce(F.element_at(metadata, F.lit(k)).cast("string") == str(v), F.lit(False))
    return out


def concept_matches(text: Column, concepts: list[str]) -> Column:
    """The concepts that a text holds: as a substring from four letters on, as a whole word below."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" "))
    hits = [F.when(F.contains(low, F.lit(c)) if len(c) >= 4 else F.contains(spaced, F.lit(f" {c} ")), F.lit(c)) for c in concepts]
    return F.array_compact(F.array(*hits))


def coverage_verdict(covered: Column, total: int, supporting: Column) -> Column:
    """By the share of concepts covered and whether any hit supports the answer."""
    share = covered / total
    return F.when((supporting == 0) | (share < 0.34), "insufficient").when(share >= 0.75, "answerable").when(share >= 0.6, "partially").otherwise("insufficient")


def coverage_by_group(docs: DataFrame, group: str, text: str, concepts: list[str]) -> DataFrame:
    """Of each group: concepts covered by any row, rows that hold half of them or more, and a verdict."""
    found = docs.select(group, concept_matches(F.col(text), concepts).alias("c"))
    flags = [F.max(F.array_contains("c", c).cast("int")).alias(f"c{i}") for i, c in enumerate(concepts)]
    out = found.groupBy(group).agg(*flags, F.count_if(F.size("c") * 2 >= len(concepts)).alias("supporting"))
    covered = sum((F.col(f"c{i}") for i in range(len(concepts))), F.lit(0))
    return out.select(group, covered.alias("covered"), "supporting").withColumn("verdict", coverage_verdict(F.col("covered"), len(concepts), F.col("supporting")))


def row_relevance(resolved: Column, n_rows: Column, hardcoded: Column, grouped: Column, score: Column) -> Column:
    """Why a table row counts as primary: code, small table, hardcoding, small ungrouped table, or a high score."""
    return (
        F.when(resolved, "code_resolved")
        .when(n_rows <= 80, "small_customizing")
        .when(hardcoded, "hardcoding")
        .when(~grouped & (n_rows <= 100), "ungrouped")
        .when((n_rows <= 20) & (score >= 15), "high_score")
        .otherwise("not_primary")
    )


def claim_tier(authoritative: Column, from_code: Column, inferred: Column) -> Column:
    return F.when(authoritative, "AUTHORITATIVE").when(from_code, "CODE_DERIVED").when(inferred, "INFERRED").otherwise("UNSUPPORTED")


def hits_at(ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...], id_col: str = "doc_id") -> DataFrame:
    """One row per cut: how many of the first ranks are relevant, precision and recall."""
    total = relevant.agg(F.count(F.lit(1)).alias("n_relevant"))
    marked = ranked.join(relevant.select(id_col, F.lit(1).alias("_hit")), id_col, "left")
    at = marked.crossJoin(F.broadcast(ranked.sparkSession.createDataFrame([(c,) for c in cuts], "cut int"))).filter("rank <= cut")
    out = at.groupBy("cut").agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("n_hits")).crossJoin(F.broadcast(total))
    return out.select("cut", "n_hits", (F.col("n_hits") / F.col("cut")).alias("precision"), (F.col("n_hits") / F.col("n_relevant")).alias("recall"))


def evidence_delta(before: DataFrame, after: DataFrame, key: str, kind: str) -> DataFrame:
    """(kind, n_new): keys of after that before lacks."""
    return after.select(kind, key).distinct().join(before.select(kind, key).distinct(), [kind, key], "left_anti").groupBy(kind).agg(F.count(F.lit(1)).alias("n_new"))
