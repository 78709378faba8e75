"""Graphs as two tables: nodes (node_id, ...) and edges (from_id, to_id, relation, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialize


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, type, name, source, authoritative) to one row per node and type, as one id may name things of different
    types: sorted names and sources, flags OR-ed."""
    return nodes.groupBy("node_id", "type").agg(
        F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"),
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
        F.max("authoritative").alias("authoritative"),
    )


def edge_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 24)


def merge_edges(edges: DataFrame, keys: tuple[str, ...] = ("from_id", "relation", "to_id", "evidence_class")) -> DataFrame:
    """One row per edge identity: its id, occurrences, distinct contexts and whether any is authoritative."""
    grouped = edges.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences"), F.array_join(F.array_sort(F.collect_set("context")), "|").alias("contexts"), F.max("authoritative").alias("authoritative"))
    return grouped.withColumn("edge_id", edge_id(*map(F.col, keys)))


def name_collisions(nodes: DataFrame) -> DataFrame:
    """Names that more than one type has: name, types, whether they are namespaced (conflicts otherwise)."""
    grouped = nodes.groupBy(F.upper("name").alias("name")).agg(F.countDistinct("type").alias("n_types"), F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))
    return grouped.filter("n_types > 1").withColumn("kind", F.when(F.col("name").startswith("/"), "namespace").otherwise("conflict"))


def unify_relations(edges: DataFrame, table: dict[str, str], default: str = "RELATED") -> DataFrame:
    mapping = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return edges.withColumn("relation_unified", F.coalesce(F.element_at(mapping, F.col("relation")), F.lit(default)))


def neighbours(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(seed, to_id, relation): targets of edges from each seed, the first `most` by relation and target. A hub's edges
    are ranked and cut in the tasks that read them before they meet."""
    found = edges.join(seeds.select(F.col("node_id").alias("from_id")).distinct(), "from_id", "left_semi").select(F.col("from_id").alias("seed"), "to_id", "relation").distinct()
    placed = found.withColumn("_p", F.row_number().over(Window.partitionBy("seed").orderBy("relation", "to_id")))
    return placed.filter(F.col("_p") <= most).drop("_p")


def bounded_search(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(node_id, distance): nodes within so many undirected hops of the seeds, at their least distance.

    One join and one aggregate for each hop; the frontier is what the hop before has added, and an edge list is read once
    a hop. Distances are combined before they are shuffled, so a hub costs a row for each task.
    """
    both = edges.select("from_id", "to_id").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).distinct()
    found = seeds.select("node_id").distinct().withColumn("distance", F.lit(0))
    frontier = found
    for hop in range(1, hops + 1):
        reached = frontier.join(both, frontier.node_id == both.from_id).select(F.col("to_id").alias("node_id")).distinct()
        frontier = reached.join(found, "node_id", "left_anti").withColumn("distance", F.lit(hop))
        found = found.unionByName(frontier)
    return found


# Relations that lead to a node but not on from it.
WEAK = ("CODE_PERFORMS_FORM_ROUTINE", "PROGRAM_CONTAINS_INCLUDE")


def paths_from(seeds: DataFrame, edges: DataFrame, hops: int = 2, weak: tuple[str, ...] = WEAK) -> DataFrame:
    """(node_id, seed_id, distance, path, rank): each node within so many undirected hops of the seeds with one shortest path.

    edges: (edge_id, from_id, to_id, relation, rank). Of the paths of least distance the one counts whose last edge has the
    least rank (the strongest evidence), then the one whose edge ids come first. A node that weak relations alone reach at
    its least distance is a result and isn't expanded.

    A hop is one join with the edges and one aggregate whose labels, structs in that order, are combined before they are
    shuffled; labels are written once a hop, so no hop computes the ones before it again.
    """
    strong = ~F.upper("relation").isin(*weak) if weak else F.lit(True)
    step = F.struct("rank", "edge_id", strong.alias("strong"))
    both = edges.select("from_id", "to_id", step.alias("step")).unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), step.alias("step"))).filter("from_id <> to_id")
    found = seeds.select("node_id").distinct().select("node_id", F.col("node_id").alias("seed_id"), F.lit(0).alias("distance"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("open"))
    found = frontier = materialize(found, "paths")
    for hop in range(1, hops + 1):
        reached = frontier.filter("open").join(both, frontier.node_id == both.from_id).select(
            F.col("to_id").alias("node_id"), F.struct(F.col("step.rank").alias("rank"), F.concat("path", F.array("step.edge_id")).alias("path"), "seed_id").alias("label"), F.col("step.strong").alias("strong")
        )
        best = reached.groupBy("node_id").agg(F.min("label").alias("label"), F.max("strong").alias("open"))
        new = best.join(found.select("node_id"), "node_id", "left_anti")
        frontier = materialize(new.select("node_id", "label.seed_id", F.lit(hop).alias("distance"), "label.path", F.col("label.rank").cast("int").alias("rank"), "open"), "paths")
        found = found.unionByName(frontier)
    return found.drop("open")


def until_nothing_new(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, most: int = 100) -> DataFrame:
    """The rows of seeds and of all rounds, with the round that found them: a round is step() of what the round before has
    added, without what is known. Rounds end with one that adds nothing; their number depends on the data, and more than
    `most` raise RuntimeError. Each round's rows are written once."""
    known = added = materialize(seeds.dropDuplicates([key]).withColumn("round", F.lit(0)), "rounds")
    for n in range(1, most + 1):
        fresh = step(added.drop("round")).dropDuplicates([key]).join(known.select(key), key, "left_anti")
        added = materialize(fresh.select(*(c for c in known.columns if c != "round")).withColumn("round", F.lit(n)), "rounds")
        if added.isEmpty():
            return known
        known = known.unionByName(added)
    raise RuntimeError(f"still something new after {most} rounds")


def resolved_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends are known."""
    open_end = F.col("from_id").contains("?") | F.col("to_id").contains("?")
    return edges.filter(~open_end & ~F.coalesce(F.col("relation").isin("DYNAMIC_UNRESOLVED", "SOURCE_SCOPE_UNKNOWN"), F.lit(False)))


def candidate_cost(authority: Column, direct: Column, relation: Column, distance: Column, occurrences: Column) -> Column:
    """Less is better: authority, then directness, relation, distance, and up to 50 occurrences as a discount."""
    return authority * 1000 + direct * 100 + relation * 20 + distance * 10 - F.least(occurrences, F.lit(50))


def max_merge_edges(edges: DataFrame) -> DataFrame:
    """Of equal (from_id, relation, to_id) the highest confidence."""
    return edges.groupBy("from_id", "relation", "to_id").agg(F.max("confidence").alias("confidence"))
