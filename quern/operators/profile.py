"""Profiles and inventories: distributions, table profiles, rule groups, densities, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.fuse import with_gap


def value_distribution(rows: DataFrame, columns: list[str], top: int = 6) -> DataFrame:
    """(field, value, n, place): the most frequent values of each column, null left out, ties by value."""
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").filter("value is not null")
    counts = pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).filter(F.col("place") <= top)


def top_counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def table_profile(rows: DataFrame, name: str, key: str, category: Column) -> DataFrame:
    """One row: rows, distinct keys, null keys and category of a table."""
    return rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.count_if(F.col(key).isNull()).alias("n_null_keys")).withColumn("category", category)


def table_category(n_rows: Column, n_keys: Column) -> Column:
    """By size and key coverage."""
    return F.when(n_rows == 0, "EMPTY").when(n_rows <= 80, "SMALL_CUSTOMIZING").when(n_keys == n_rows, "MASTER_DATA").otherwise("TRANSACTIONAL")


def parent_groups(rows: DataFrame, parent: str, child: str) -> DataFrame:
    """Rule groups by parent key: keys with two rows or more, with rows and distinct children."""
    return rows.groupBy(parent).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(child).alias("n_children")).filter("n_rows >= 2")


def signature_groups(rows: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """Rule groups by which columns are filled: signatures with so many rows."""
    signature = F.concat_ws("", *(F.when(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 0, "1").otherwise("0") for c in columns))
    return rows.groupBy(signature.alias("signature")).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= least)


def prefix_groups(rows: DataFrame, text: str, width: int = 12, least: int = 3) -> DataFrame:
    """Rule groups by the first characters of a text."""
    return rows.groupBy(F.upper(F.substring(F.coalesce(text, F.lit("")), 1, width)).alias("prefix")).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= least)


def density_selection(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """Groups by hits * 100 + share * 20 + min(n, 50) / 100, with the lead over the next and a confidence."""
    counted = rows.groupBy(group).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    score = F.col("hits") * 100 + F.col("hits") / F.col("n") * 20 + F.least("n", F.lit(50)) * 0.01
    scored = with_gap(counted.withColumn("score", score), "score", group)
    high = (F.col("hits") >= 10) & (F.col("hits") / F.col("n") >= 0.35) & (F.col("gap") >= 50)
    medium = (F.col("hits") >= 5) & (F.col("hits") / F.col("n") >= 0.2)
    return scored.withColumn("confidence", F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"))


def inventory(rows: DataFrame, item: str, medium: str, partner: str) -> DataFrame:
    """One row per medium: distinct items, distinct partners, rows, and the share of all items."""
    grouped = rows.groupBy(medium).agg(F.countDistinct(item).alias("n_items"), F.countDistinct(partner).alias("n_partners"), F.count(F.lit(1)).alias("n_rows"))
    total = rows.agg(F.countDistinct(item).alias("n_all"))
    return grouped.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_items") / F.col("n_all"))


def entity_rollup(rows: DataFrame, parent: str, member: str, distance: str, role: str) -> DataFrame:
    """Parents with their members, least distance and a class by the roles seen."""
    grouped = rows.groupBy(parent).agg(F.countDistinct(member).alias("n_members"), F.min(distance).alias("min_distance"), F.array_sort(F.collect_set(role)).alias("roles"))
    kind = F.when(F.size("roles") > 1, "MIXED").when(F.array_contains("roles", "assistant"), "PRODUCER").otherwise("CONSUMER")
    return grouped.select(parent, "n_members", "min_distance", F.array_join("roles", "|").alias("roles"), kind.alias("class"))


def progress(done: Column, countable: Column, locked: Column) -> list[Column]:
    """Aggregates: done and countable of unlocked steps, and their share in per cent; of all steps if all are locked."""
    open_only = F.count_if(~locked) > 0
    d = F.when(open_only, F.sum(F.when(~locked, done))).otherwise(F.sum(done))
    c = F.when(open_only, F.sum(F.when(~locked, countable))).otherwise(F.sum(countable))
    return [d.alias("done"), c.alias("countable"), F.when(c > 0, F.round(100 * d / c)).otherwise(0.0).alias("percent")]


def value_catalogue(rows: DataFrame, fields: list[str], kept: int = 24) -> DataFrame:
    """(field, values, n): distinct values of each field, the first `kept` of them in order."""
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields))).alias("x")).select("x.*").filter("value is not null").distinct()
    first = pairs.withColumn("_p", F.row_number().over(Window.partitionBy("field").orderBy("value"))).filter(F.col("_p") <= kept)
    lists = first.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("values"))
    return lists.join(pairs.groupBy("field").agg(F.count(F.lit(1)).alias("n")), "field")
