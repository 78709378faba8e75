"""Incremental recomputation by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, change): added, changed, unchanged or removed."""
    a, b = old.select(key, F.col(hash_col).alias("_old")), new.select(key, F.col(hash_col).alias("_new"))
    joined = a.join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return joined.select(key, change.alias("change"))


def pending(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Rows of new that old lacks or has with another hash."""
    return new.join(old.select(key, hash_col), [key, hash_col], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, hash_col: str, created: str) -> DataFrame:
    """old with the rows of new in place of theirs; what is unchanged stays and what is changed keeps its first date."""
    columns = old.columns
    was = old.select(key, F.col(hash_col).alias("_hash"), F.struct(*(c for c in columns if c != key)).alias("_old"))
    both = new.select(key, F.struct(*(c for c in columns if c != key)).alias("_new")).join(was, key, "full_outer")
    keep = F.col("_new").isNull() | (F.col("_hash") == F.col(f"_new.{hash_col}"))
    row = F.when(keep, F.col("_old")).otherwise(F.col("_new"))
    first = F.coalesce(F.col(f"_old.{created}"), F.col(f"_new.{created}"))
    out = both.select(key, row.alias("r"), first.alias("_first"))
    return out.select(*(F.col(key) if c == key else F.col("_first").alias(c) if c == created else F.col(f"r.{c}").alias(c) for c in columns))


def replace_partition(index: DataFrame, kind: str, value: str, batch: DataFrame) -> DataFrame:
    """The index without the rows of one kind, and the batch in their place."""
    return index.filter(F.col(kind).isNull() | (F.col(kind) != value)).unionByName(batch)


def next_batch(todo: DataFrame, priority: str, key: str, n: int) -> DataFrame:
    """The first n by priority, then key."""
    return todo.orderBy(priority, key).limit(n)


def both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of them has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right_only")))
