"""Fusion of ranked lists, tiers and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialize

RRF_K = 60


def reciprocal_rank_fusion(lists: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(list, doc_id, rank, score) to (doc_id, rrf, n_lists): sum of 1 / (60 + rank), 15 % more for each further list,
    and a hundredth of the best score."""
    grouped = lists.groupBy(id_col).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("s"), F.countDistinct("list").alias("n_lists"), F.max("score").alias("best"))
    return grouped.select(id_col, (F.col("s") * (1 + 0.15 * (F.col("n_lists") - 1)) + 0.01 * F.col("best")).alias("rrf"), "n_lists")


def baseline_fusion(lists: DataFrame, baseline: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fused): documents of the baseline list keep their score and gain from support and from a high rank;
    others count by their fused rank alone, so that support can't push the baseline out."""
    base = F.col("list") == baseline
    grouped = lists.groupBy(id_col).agg(
        F.max(F.when(base, F.col("score"))).alias("base_score"),
        F.min(F.when(base, F.col("rank"))).alias("base_rank"),
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("agg"),
        F.count_if(~base).alias("support"),
        F.max(F.when(~base, F.col("score"))).alias("other"),
    )
    kept = F.col("base_score") + 0.5 * F.col("agg") + 0.25 * F.col("support") + F.greatest(F.lit(0.0), (20 - F.col("base_rank")) * 0.05)
    new = F.col("agg") + 0.1 * F.least(F.coalesce("other", F.lit(0.0)), F.lit(5.0))
    return grouped.select(id_col, F.when(F.col("base_score").isNotNull(), kept).otherwise(new).alias("fused"), F.col("base_score").isNotNull().alias("in_baseline"))


def tiered(rows: DataFrame, tier: Column, score: Column, group: str, most_per_group: int, id_col: str = "doc_id") -> DataFrame:
    """rows with tier and place: ordered by tier, score and id, at most so many of a group within a tier."""
    scored = rows.withColumn("tier", tier).withColumn("tier_score", score)
    within = Window.partitionBy("tier", group).orderBy(F.desc("tier_score"), id_col)
    return scored.withColumn("place", F.row_number().over(within)).filter(F.col("place") <= most_per_group)


def best_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. A filter on row_number is kept to n rows a group before the shuffle as well."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= n)


def budgets(rows: DataFrame, group: str, budget: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """Rows within their group's budget (a table group, budget), then the first cap of all."""
    kept = rows.join(budget, group).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= F.col("budget"))
    return kept.orderBy(*order).limit(cap)


def best_per_key(rows: DataFrame, key: str, score: str, id_col: str) -> DataFrame:
    """Of each key the row with the highest score, ties by the smaller id; an aggregate, so hot keys are combined early."""
    packed = F.max_by(F.struct(*rows.columns), F.struct(F.col(score), -F.col(id_col))).alias("r")
    return rows.groupBy(key).agg(packed).select("r.*")


def with_gap(rows: DataFrame, score: str, id_col: str, group: list[str] | None = None) -> DataFrame:
    """rows with the score's lead over the next one of the group; the last has its own score.

    Without a group rows are dealt in ranges of the order, so no task has all: the last of a range is followed by the first
    of the next one, of which there is one row each.
    """
    lead = lambda by: F.lead(score).over(Window.partitionBy(*by).orderBy(F.desc(score), id_col))
    if group:
        return rows.withColumn("gap", F.col(score) - F.coalesce(lead(group), F.lit(0.0)))
    dealt = materialize(rows.repartitionByRange(F.desc(score), F.asc(id_col)).withColumn("_range", F.spark_partition_id()), "ranges")
    heads = dealt.groupBy("_range").agg(F.max(score).alias("_head"))
    borders = heads.select("_range", F.lead("_head").over(Window.orderBy("_range")).alias("_border"))  # a row for each range
    return dealt.join(borders, "_range").withColumn("gap", F.col(score) - F.coalesce(lead(["_range"]), "_border", F.lit(0.0))).drop("_range", "_border")
