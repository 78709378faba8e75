"""Canonicalisation: routing, keys, hashes, dedupe with a collision report, relation roll-ups.

Each function takes and returns DataFrames. First and last always mean the order of a column given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def route(records: DataFrame, kinds: tuple[str, ...], by: str = "record_type") -> dict[str, DataFrame]:
    """One frame for each kind, and 'other' for the rest, null included."""
    out = {k: records.filter(F.col(by) == k) for k in kinds}
    out["other"] = records.filter(F.col(by).isNull() | ~F.col(by).isin(*kinds))
    return out


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), 256)


def stable_hash(values: Column) -> Column:
    """Of a map, whatever the order of its keys."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(values))), 256)


def primary_key(values: Column, order: list[str]) -> Column:
    """FIELD=value of the key fields in their order, then of the others by name; white space collapsed."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    known = F.array(*(F.concat(F.lit(f"{k}="), clean(F.element_at(values, F.lit(k)))) for k in order)) if order else F.array().cast("array<string>")
    extra = F.filter(F.array_sort(F.map_keys(values)), lambda k: ~k.isin(*order)) if order else F.array_sort(F.map_keys(values))
    return F.array_join(F.concat(known, F.transform(extra, lambda k: F.concat(k, F.lit("="), clean(F.element_at(values, k))))), "|")


def dedupe_report(rows: DataFrame, keys: list[str], hash_col: str, order: str) -> DataFrame:
    """One row per key: the first row's order value, rows, distinct contents, and its status.

    unique: one row; duplicate: more rows with one content; collision: more contents under one key.
    """
    grouped = rows.groupBy(*keys).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(hash_col).alias("n_contents"))
    status = F.when(F.col("n_rows") == 1, "unique").when(F.col("n_contents") == 1, "duplicate").otherwise("collision")
    return grouped.withColumn("status", status)


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, whole. An aggregate, so that a hot key is combined before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.col(order)).alias("row")
    return rows.groupBy(*keys).agg(packed).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest)).select(*rows.columns)


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, whole."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.col(order)).alias("row")
    return rows.groupBy(*keys).agg(packed).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest)).select(*rows.columns)


def duplicate_groups(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Groups of two rows or more with the same content: hash, first id, rows."""
    hashed = rows.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def aggregate_relations(edges: DataFrame, context: str, keys: tuple[str, ...] = ("from_type", "from_name", "relation_type", "to_type", "to_name")) -> DataFrame:
    """One row per edge with its occurrences and distinct contexts, sorted and joined by '|'."""
    sets = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count"), F.collect_set(context).alias("contexts"))
    return sets.withColumn("contexts", F.array_join(F.array_sort("contexts"), "|"))


def split_unresolved(edges: DataFrame, name: str = "to_name") -> tuple[DataFrame, DataFrame]:
    """Edges that lead to a known name and those that lead to UNRESOLVED_*."""
    open_end = F.coalesce(F.col(name).startswith("UNRESOLVED_"), F.lit(True))
    return edges.filter(~open_end), edges.filter(open_end)


def request_rollup(requests: DataFrame) -> DataFrame:
    """(type, name, reason, source, priority, requires_validation) to one row per (type, name), most urgent first by rank."""
    out = requests.groupBy("type", "name").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"),
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
        F.min("priority").alias("priority"),
        F.max("requires_validation").alias("requires_validation"),
    )
    return out


def field_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: filled and null values, distinct values, shortest and longest, in one pass over rows."""
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return pairs.groupBy("field").agg(
        F.count("value").alias("n_filled"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.countDistinct("value").alias("n_distinct"),
        F.min(F.length("value")).alias("min_len"),
        F.max(F.length("value")).alias("max_len"),
    )


def required_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with missing, the sorted names of required fields that are null or blank."""
    blank = [F.when(F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) == 0, F.lit(c)) for c in sorted(fields)]
    return rows.withColumn("missing", F.array_compact(F.array(*blank)))


def numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with their place within a key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
