"""Selection in tiers and passes: what is found first counts, and each row says how it was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_tiers(first: DataFrame, links: DataFrame, damping: float, most: int | None = None) -> DataFrame:
    """(id, tier, score, reason): the first tier, and a second one that links derive from it.

    first: (id, score, reason), links: (from_id, to_id, reason). A linked candidate scores damping times the best of what
    leads to it. Of what names an id twice the lower tier counts, then the higher score, then the reason. With `most`, that
    many are kept, by tier, score and id.
    """
    own = first.select("id", F.lit(1).alias("tier"), "score", "reason")
    best = own.groupBy("id").agg(F.max("score").alias("score"))
    led = links.join(best, links.from_id == best.id).select(F.col("to_id").alias("id"), F.lit(2).alias("tier"), (F.col("score") * damping).alias("score"), "reason")
    kept = own.unionByName(led).groupBy("id").agg(F.min(F.struct("tier", (-F.col("score")).alias("less"), "reason")).alias("b")).select("id", "b.tier", (-F.col("b.less")).alias("score"), "b.reason")
    return kept if most is None else kept.orderBy("tier", F.col("score").desc(), "id").limit(most)


def in_passes(rows: DataFrame, passes: list[tuple[str, Column]], siblings: tuple[str, str, Column] | None, order: list[str], most: int) -> DataFrame:
    """rows that a pass takes, with `found_by`: each row goes to the first pass whose condition it meets, so passes exclude
    each other, and `most` is one limit for all, by pass and then by order.

    siblings: (name, object column, condition) of a last pass over what is left: rows that meet its condition and whose
    object an earlier pass has found. All passes but that one are one expression over one scan.
    """
    names = [name for name, _ in passes]
    marked = rows.withColumn("found_by", F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in passes), F.lit(None).cast("string")))
    found = marked.filter("found_by is not null")
    if siblings:
        name, obj, cond = siblings
        names.append(name)
        known = found.select(obj).distinct()
        found = found.unionByName(marked.filter(F.col("found_by").isNull() & cond).join(known, obj, "left_semi").select(*marked.columns[:-1], F.lit(name).alias("found_by")))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("found_by"))
    return found.orderBy(place, *order).limit(most)
