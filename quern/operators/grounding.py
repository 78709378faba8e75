"""Grounding of hits in a question's topic and entities, and gates that decide how far a search goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def soft_type_filter(kind: Column, wanted: list[str], present: list[str], confidence: float, least: float = 0.7) -> Column:
    """The types that a planner wants, or no filter where it is unsure or the index has none of them."""
    known = [t for t in wanted if t in present]
    return F.coalesce(kind.isin(*known), F.lit(False)) if known and confidence >= least else F.lit(True)


def topic_status(topic: Column, entity: Column, has_topic: bool) -> Column:
    """confirmed, possible or not_relevant, from matches of topic terms and of entities.

    Where the question has a topic apart from its entities, a hit on entities alone isn't relevant.
    """
    if not has_topic:
        return F.when(entity > 0, "confirmed").otherwise("not_relevant")
    return F.when((topic >= 2) | ((topic >= 1) & (entity > 0)), "confirmed").when(topic >= 1, "possible").otherwise("not_relevant")


def ground_topics(hits: DataFrame, status: Column, score: str, id_col: str) -> DataFrame:
    """hits that are relevant with topic_status, in order: confirmed first, then by score and id."""
    marked = hits.withColumn("topic_status", status).filter("topic_status <> 'not_relevant'")
    return marked.orderBy(F.when(F.col("topic_status") == "confirmed", 0).otherwise(1), F.desc(score), id_col)


def entity_grounding(strong: Column, weak: Column, other: Column) -> Column:
    """By where an entity is found: in strong fields, in weak ones, another in its place, or nowhere."""
    return F.when(strong, "confirmed").when(weak, "possible").when(other, "contradicted").otherwise("not_found")


#: Names of a question; more are refused, as each text is searched for each.
MOST_NAMES = 200


def entity_report(docs: DataFrame, entities: DataFrame, strong: str, weak: str, id_col: str) -> DataFrame:
    """(name, status, n_strong, n_weak) for the names of a question, MOST_NAMES at most: one pass over docs and a row for
    each name and task. entities: (name) or (name, kind); a name that isn't found is contradicted where another of its
    kind is found in strong fields."""
    kinds = entities.select("name", "kind" if "kind" in entities.columns else F.lit("").alias("kind")).distinct().limit(MOST_NAMES + 1).collect()
    if len(kinds) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    at = F.array(*(F.struct(F.lit(r["name"]).alias("name"), F.lit(r["kind"]).alias("kind"), F.contains(F.lower(strong), F.lit(r["name"].lower())).alias("s"), F.contains(F.lower(weak), F.lit(r["name"].lower())).alias("w")) for r in sorted(kinds)))
    counts = docs.select(id_col, F.explode(at).alias("e")).groupBy("e.kind", "e.name").agg(F.count_if("e.s").alias("n_strong"), F.count_if(F.col("e.w") & ~F.col("e.s")).alias("n_weak"))
    others = F.sum("n_strong").over(Window.partitionBy("kind")) > F.col("n_strong")
    return counts.select("name", entity_grounding(F.col("n_strong") > 0, F.col("n_weak") > 0, others).alias("status"), "n_strong", "n_weak")


def process_tier(own: Column, shared: Column, named: Column) -> Column:
    """PRIMARY: terms of the process itself; SECONDARY: a shared term and a named object; otherwise EXCLUDED, and why."""
    tier = F.when(own >= 1, "PRIMARY").when((shared >= 1) & named, "SECONDARY").otherwise("EXCLUDED")
    why = F.when((own == 0) & (shared >= 1) & ~named, "shared_token_only").when(own + shared == 0, "no_token")
    return F.struct(tier.alias("tier"), why.alias("reason"))


def budget_gate(is_literal: Column, literal_hits: Column, deep: Column, anchors: Column, exact_hits: Column, sufficient: Column) -> Column:
    """How far a search goes: closed where a literal isn't found, deep where it is asked for, retrieval for anchors without
    exact hits, and otherwise exact where the hits suffice."""
    closed, open_anchors = is_literal & (literal_hits == 0), (anchors > 0) & (exact_hits == 0)
    return F.when(closed, "CLOSED").when(deep, "DEEP_ANALYSIS").when(open_anchors, "RETRIEVAL").when(sufficient, "EXACT").otherwise("RETRIEVAL")


def without_noise(hits: DataFrame, name: str, kind: str, symbols: list[str], noise: tuple[str, ...] = ("ABAPGIT",), loose: tuple[str, ...] = ("control_table", "master_field")) -> DataFrame:
    """In a search for symbols: hits without noise objects and without table rows that name none of the symbols."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    noisy, related = F.lit(False), F.lit(False)
    for n in noise:
        noisy = noisy | F.contains(upper, F.lit(n))
    for s in symbols:
        related = related | F.contains(upper, F.lit(s.upper()))
    return hits.filter(~noisy & (~F.coalesce(F.col(kind).isin(*loose), F.lit(False)) | related))


def strong_seeds(found: DataFrame, group: str, coverage: str, distance: str, n_terms: int, most: int = 5) -> DataFrame:
    """Objects whose hits cover two terms or more (one of a single term) at distance 1 or less, the best first."""
    grouped = found.groupBy(group).agg(F.max(coverage).alias("coverage"), F.min(distance).alias("distance"))
    return grouped.filter((F.col("coverage") >= min(2, n_terms)) & (F.col("distance") <= 1)).orderBy(F.desc("coverage"), "distance", group).limit(most)


def support_by_object(hits: DataFrame, supporting: DataFrame, obj: str, has_evidence: str, id_col: str) -> DataFrame:
    """Ids of supporting hits and of hits with evidence on the same object."""
    objects = hits.join(supporting.select(id_col), id_col, "left_semi").select(obj).distinct()
    shared = hits.filter(F.col(has_evidence)).join(objects, obj, "left_semi").select(id_col)
    return supporting.select(id_col).unionByName(shared).distinct()


def claim_budget(counts: DataFrame, needs: dict[str, int], kind: str = "kind", n: str = "n") -> DataFrame:
    """(kind, need, n, met) for an intent's least counts of evidence; kinds without rows count 0."""
    wanted = counts.sparkSession.createDataFrame(sorted(needs.items()), f"{kind} string, need int")
    return wanted.join(counts.select(kind, n), kind, "left").select(kind, "need", F.coalesce(n, F.lit(0)).alias("n")).withColumn("met", F.col("n") >= F.col("need"))
