"""Evidence: per-object caps, selections, merges of hit lists, inventories and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_most_per_object(hits: DataFrame, obj: str, n: int, order: list[Column]) -> DataFrame:
    return hits.withColumn("_p", F.row_number().over(Window.partitionBy(obj).orderBy(*order))).filter(F.col("_p") <= n).drop("_p")


def distinct_places(hits: DataFrame, place: list[str], order: list[str], most: int) -> DataFrame:
    """One hit of each place, the first by order, and of those the first `most`."""
    rest = [c for c in hits.columns if c not in place]
    first = hits.groupBy(*place).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*place, "r.*")
    return first.orderBy(*order).limit(most)


def coherent_selection(hits: DataFrame, bucket: str, caps: dict[str, int], other: int, order: list[Column], most: int) -> DataFrame:
    """At most so many hits of each bucket, and `most` in all."""
    cap = F.coalesce(*(F.when(F.col(bucket) == k, F.lit(v)) for k, v in caps.items()), F.lit(other))
    placed = hits.withColumn("_p", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col("_p") <= cap)
    return placed.drop("_p").orderBy(*order).limit(most)


def preserved_merge(seeds: DataFrame, primary: DataFrame, id_col: str, rank: str) -> DataFrame:
    """Seeds first, then the primary list, each id once, ranks anew. Both are hit lists: what a top-k has left."""
    both = seeds.select(id_col, F.col(rank).alias("_r"), F.lit(0).alias("_s")).unionByName(primary.select(id_col, F.col(rank).alias("_r"), F.lit(1).alias("_s")))
    once = both.groupBy(id_col).agg(F.min(F.struct("_s", "_r")).alias("k"))
    return once.select(id_col, F.row_number().over(Window.orderBy("k._s", "k._r", id_col)).alias(rank), (F.col("k._s") == 0).alias("is_seed"))


def usefulness(hits: DataFrame, weight: dict[str, float], kind: str, coverage: Column, rank: str, limit: int) -> DataFrame:
    """By the weight of the hit's type and three points a term; nothing at or below 0."""
    score = F.coalesce(*(F.when(F.col(kind) == k, F.lit(v)) for k, v in weight.items()), F.lit(0.0)) + 3.0 * coverage
    return hits.withColumn("useful", score).filter("useful > 0").orderBy(F.desc("useful"), rank).limit(limit)


def evidence_score(kind_score: Column, confidence: Column, path: Column) -> Column:
    """A class's score and ten points of confidence; 30 off without a source path."""
    return kind_score + 10 * confidence - F.when(path.isNull(), 30).otherwise(0)


def exact_coverage_rank(tier: Column, exact: Column, combined: Column) -> Column:
    """Tier points, up to 200 of exact matches and up to 100 of the combined score."""
    return tier + F.least(F.lit(200.0), 40.0 * exact) + F.least(F.lit(100.0), combined)


def anchor_merge(anchors: DataFrame) -> DataFrame:
    """(kind, norm, confidence, round) to one row an anchor: highest confidence, first round, and whether it is strong."""
    merged = anchors.groupBy("kind", "norm").agg(F.max("confidence").alias("confidence"), F.min("round").alias("first_round"))
    return merged.withColumn("strong", (F.col("confidence") >= 0.55) & (F.length("norm") >= 3))


def full_inventory(types: DataFrame, processing: DataFrame, key: str) -> DataFrame:
    """Keys of either side with what each knows: in_types, in_processing, and their columns."""
    joined = types.withColumn("_t", F.lit(True)).join(processing.withColumn("_p", F.lit(True)), key, "full_outer")
    return joined.withColumn("in_types", F.coalesce("_t", F.lit(False))).withColumn("in_processing", F.coalesce("_p", F.lit(False))).drop("_t", "_p")


def hardcoded_inventory(found: DataFrame, value: str, active: str, place: list[str]) -> DataFrame:
    """One row per value: active and comment-only occurrences, places, its first active place, and whether it is used more than once."""
    spot = F.concat_ws("|", *(F.col(p).cast("string") for p in place))
    grouped = found.groupBy(value).agg(F.count_if(active).alias("n_active"), F.count_if(~F.col(active)).alias("n_comment"), F.countDistinct(F.when(F.col(active), spot)).alias("n_places"), F.min(F.when(F.col(active), spot)).alias("first_place"))
    return grouped.filter("n_active > 0").withColumn("multi_use", F.col("n_active") >= 2)


def seed_profile(attributes: DataFrame, owner: str, partner: str, value: str, top: int = 5) -> DataFrame:
    """One row: values, distinct owners and partners, and the most frequent values."""
    counts = attributes.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(top)
    best = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).cast("string").alias("v")))), lambda x: F.concat_ws("=", x["v"], (-x["m"]).cast("string"))), ",").alias("top_values"))
    return attributes.agg(F.count(F.lit(1)).alias("n_values"), F.countDistinct(owner).alias("n_owners"), F.countDistinct(partner).alias("n_partners")).crossJoin(best)


def rule_rollup(rows: DataFrame, rule: str, member: str, confidence: str) -> DataFrame:
    """One row per rule: members, least and greatest confidence."""
    return rows.groupBy(rule).agg(F.countDistinct(member).alias("n_members"), F.min(confidence).alias("least"), F.max(confidence).alias("most"))


def source_coverage(frames: dict[str, DataFrame]) -> DataFrame:
    """(source, n_records, status) of each source, counted in one job."""
    out = None
    for name, frame in sorted(frames.items()):
        part = frame.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_records"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("status", F.when(F.col("n_records") > 0, "available").otherwise("empty"))


def prediction_metrics(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per kind (the first key): true, found and common keys, recall, precision."""
    kind = keys[0]
    a, b = truth.select(*keys).distinct().withColumn("_t", F.lit(1)), found.select(*keys).distinct().withColumn("_f", F.lit(1))
    joined = a.join(b, keys, "full_outer")
    out = joined.groupBy(kind).agg(F.count("_t").alias("n_true"), F.count("_f").alias("n_found"), F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("n_common"))
    return out.withColumn("recall", F.when(F.col("n_true") > 0, F.col("n_common") / F.col("n_true"))).withColumn("precision", F.when(F.col("n_found") > 0, F.col("n_common") / F.col("n_found")))


def sibling_units(hits: DataFrame, units: DataFrame, obj: str, unit: str) -> DataFrame:
    """Units of the objects that were hit, without those hit themselves."""
    return units.join(hits.select(obj).distinct(), obj, "left_semi").join(hits.select(obj, unit).distinct(), [obj, unit], "left_anti")


def callees(calls: DataFrame, units: DataFrame, name: str, id_col: str) -> DataFrame:
    """calls with the id of the unit of the called name, the smallest of equal names, null where it isn't known."""
    one = units.groupBy(F.upper(name).alias("_name")).agg(F.min(id_col).alias("callee"))
    return calls.join(one, F.upper(calls["called"]) == F.col("_name"), "left").drop("_name")
