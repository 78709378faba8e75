"""SimHash near-dedup with vantage-point trees.

A text's fingerprint has bit b set if over half of its shingles' XXH64 hashes have it set. Distinct fingerprints are
joined with themselves by Hamming distance:

* A vantage-point tree over a bounded sample routes every fingerprint to its home shard by its distances to the vantage
  points on the way (inner: d <= bound). A fingerprint whose ball of radius r crosses a bound from outside also visits
  the inner side, as a query. Of two fingerprints on different sides the outer one visits the inner one's shard, so no
  link is lost and none is looked for twice. The triangle inequality is what lets the other branches be pruned.
* A shard that is too large gets a tree of its own, from a sample of its members, and so on, so that shards keep their
  size whatever the table's; one that a tree can't split (a dense ball) stays.
* In a shard, queries and members are split again by vantage points until the groups are small, pruned by the same
  bounds, and compared bit by bit.
* What then is too large for one task is dealt in blocks; pairs of blocks are tasks.

A task does not return its links but a forest that connects the same fingerprints, of bounded degree and depth, so that
a ball of n fingerprints gives n edges and not n * n. Connected components then spread the smallest label over edges
until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, byte_text, int64, lookup_join, materialize, texts

WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints that a routing tree is built from, on average, those of a shard that it aims at, and rounds of trees.
SAMPLE = 20_000
SHARD = 6_000
ROUNDS = 8
#: Members and queries of one task beyond which a shard is dealt in blocks of this size.
BLOCK = 30_000
#: Group sizes below which fingerprints are compared directly.
LEAF = 512
#: Children of a forest node.
DEGREE = 16
#: Shingles hashed at a time.
SLICE = 1 << 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANKS = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of a UTF-8 text, as an unsigned integer. Fewer words than a shingle's are one shingle; none gives zero."""
    parts = text.translate(LOWER).translate(BLANKS).split(b" ")
    if b"" in parts:
        parts = [p for p in parts if p]
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    total, ones = n, np.zeros(64, np.int64)
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE)
        if len(parts) < words:
            shingles = [b" ".join(parts)]
        else:
            shingles = list(map(b" ".join, zip(*(parts[a + k : b + k] for k in range(words)), strict=True)))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row and whole text; null counts as empty."""

    def one(batch: pa.RecordBatch) -> dict:
        found = np.fromiter((fingerprint(t, words) for t in byte_text(batch.column("text"))), np.uint64, batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}

    return texts(docs).mapInArrow(batches(one, FINGERPRINTS), "doc_id long, fp long")


def split_by_vantage(points: np.ndarray, radius: int = RADIUS) -> tuple[np.uint64, int, np.ndarray] | None:
    """The best of a few vantage points: (point, bound, distances); None if the points cannot be told apart.

    The bound cuts near the middle where the fewest lie within reach of it.
    """
    best = None
    for v in points[np.linspace(0, len(points) - 1, 5).astype(int)]:
        d = np.bitwise_count(points ^ v).astype(np.int64)
        at_most = np.cumsum(np.bincount(d, minlength=65))
        for bound in range(64):
            inner = at_most[bound]
            balance = min(inner, len(points) - inner) / len(points)
            if balance >= 0.2:
                crossing = (at_most[min(64, bound + radius)] - inner) / len(points)
                cost = crossing + (0.5 - balance)
                if best is None or cost < best[0]:
                    best = (cost, v, bound, d)
    return None if best is None else best[1:]


def build_tree(points: np.ndarray, leaves: int, radius: int = RADIUS) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, bound, inner, outer) of a routing tree; a child below 0 is leaf -child - 1."""
    nodes: list[tuple[int, int, int, int]] = []
    made = [0]

    def grow(own: np.ndarray, want: int) -> int:
        found = split_by_vantage(own, radius) if want > 1 and len(own) >= 8 else None
        if found is None:
            made[0] += 1
            return -made[0]
        v, bound, d = found
        at = len(nodes)
        nodes.append((int(v), bound, 0, 0))
        inside = own[d <= bound]
        part = max(1, round(want * len(inside) / len(own)))
        nodes[at] = (int(v), bound, grow(inside, part), grow(own[d > bound], max(1, want - part)))
        return at

    grow(points, leaves)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray, radius: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, whether it is at home there) of every visit. home: whether points are at home in the tree
    at all; by default all are."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), bool) if home is None else home)]
    while todo:
        at, own, home = todo.pop()
        if not len(own):
            continue
        if at < 0:
            out.append((own, -at - 1, home))
            continue
        v, bound, inner, outer = nodes[at]
        d = np.bitwise_count(points[own] ^ np.uint64(v)).astype(np.int64)
        inside, near = d <= bound, d <= bound + radius
        # outside points near the bound visit the inner side; a visitor goes wherever its ball reaches
        todo.append((inner, own[near], home[near] & inside[near]))
        far = ~inside | (~home & (d > bound - radius))
        todo.append((outer, own[far], home[far]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0, bool)
    return np.concatenate([o for o, _, _ in out]), np.concatenate([np.full(len(o), leaf) for o, leaf, _ in out]), np.concatenate([h for _, _, h in out])


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs within the radius, one of each side, by a vantage-point recursion over the right side."""

    def walk(ls: np.ndarray, rs: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(ls) or not len(rs):
            return
        found = split_by_vantage(right[rs], radius) if len(rs) > LEAF and depth < 24 else None
        if found is None:
            step = max(1, (1 << 21) // len(rs))
            for a in range(0, len(ls), step):
                i, j = np.nonzero(np.bitwise_count(left[ls[a : a + step], None] ^ right[rs][None, :]) <= radius)
                yield ls[a : a + step][i], rs[j]
            return
        v, bound, d = found
        to = np.bitwise_count(left[ls] ^ v).astype(np.int64)
        yield from walk(ls[to <= bound + radius], rs[d <= bound], depth + 1)
        yield from walk(ls[to > bound - radius], rs[d > bound], depth + 1)

    yield from walk(np.arange(len(left)), np.arange(len(right)), depth)


class Forest:
    """Union-find over positions, by arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            a, b = low[apart], high[apart]
            if not len(a):
                break
            np.minimum.at(root, b, a)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def forest_edges(values: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the members of each component, each node having DEGREE children at most."""
    order = np.lexsort((values, root))
    grouped = root[order]
    starts = np.flatnonzero(np.r_[True, grouped[1:] != grouped[:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    child = place > 0
    parent = np.arange(len(order)) - place + (place - 1) // DEGREE
    return values[order[child]], values[order[parent[child]]]


def link_group(group: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of one shard or one pair of its blocks, as a forest."""
    table = pa.Table.from_batches(list(group))
    fp = table.column("fp").to_numpy().view(np.uint64)
    side = table.column("side").to_numpy()
    # side 0: members that others are compared with; 1: queries; 2: both
    values, at = np.unique(fp, return_inverse=True)
    members, queries = np.unique(at[side != 1]), np.unique(at[side != 0])
    forest = Forest(len(values))
    for i, j in near_pairs(values[queries], values[members], radius):
        forest.add(queries[i], members[j])
    a, b = forest_edges(values, forest.root)
    yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})


def sampled(total: int) -> Column:
    """Of `total` distinct fingerprints about SAMPLE: those with the least hashes. A filter, nothing is sorted."""
    share = min(1.0, SAMPLE / max(total, 1))
    return F.xxhash64("fp") <= F.lit(int(min(2**63 - 1, -(2**63) + share * 2**64)))


VISIT = "shard long, fp long, home boolean, final boolean"
VISIT_SCHEMA = pa.schema([("shard", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_()), ("final", pa.bool_())])
NODE = np.dtype([("point", "<u8"), ("bound", "<i8"), ("inner", "<i8"), ("outer", "<i8")])


def shard_rows(distinct: DataFrame, nodes: list, radius: int) -> DataFrame:
    """(shard, fp, home, final) for each visit; final where the tree couldn't split."""
    shared = distinct.sparkSession.sparkContext.broadcast(nodes)

    def one(batch: pa.RecordBatch) -> dict:
        fp = int64(batch.column("fp"))
        at, leaf, home = route(shared.value, fp.view(np.uint64), radius)
        return {"shard": leaf, "fp": fp[at], "home": home, "final": np.full(len(at), not shared.value)}

    return distinct.select("fp").mapInArrow(batches(one, VISIT_SCHEMA), VISIT)


def subdivided(visits: DataFrame, large: DataFrame, radius: int, sample: int, shard: int, block: int) -> DataFrame:
    """The visits of large shards (shard, n, members), routed on by a tree for each. Trees come from about `sample`
    members each; visits are routed in parts of about a block, each with a copy of its shard's tree."""

    def tree(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(group))
        points = np.sort(rows.column("fp").to_numpy().view(np.uint64))
        nodes = build_tree(points, max(2, round(rows.column("members")[0].as_py() / shard)), radius)
        yield pa.RecordBatch.from_pydict({"shard": [key[0].as_py()], "nodes": [np.array(nodes, NODE).tobytes()]})

    def routed(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = [tuple(n) for n in np.frombuffer(right.column("nodes")[0].as_py(), NODE).tolist()] if right.num_rows else []
        fp, own = left.column("fp").to_numpy(), left.column("shard")[0].as_py()
        at, leaf, home = route(nodes, fp.view(np.uint64), radius, left.column("home").to_numpy())
        names = {k: xxhash.xxh64_intdigest(f"{own}/{k}") - (1 << 63) for k in set(leaf.tolist())}
        return pa.table({"shard": pa.array([names[k] for k in leaf.tolist()], pa.int64()), "fp": fp[at], "home": home, "final": np.full(len(at), not nodes)}, schema=VISIT_SCHEMA)

    own = visits.join(large, "shard")
    chosen = own.filter(F.col("home") & (F.pmod(F.xxhash64("fp", "shard"), "members") < sample)).select("shard", "fp", "members")
    trees = chosen.groupBy("shard").applyInArrow(tree, "shard long, nodes binary")
    parts = F.ceil(F.col("n") / block)
    dealt = own.select("shard", F.pmod(F.xxhash64("fp", F.lit(1)), parts).alias("part"), "fp", "home")
    copies = trees.join(large, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "nodes")
    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(routed, VISIT)


def links(distinct: DataFrame, total: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, connecting what links of the radius connect."""
    sample = distinct.filter(sampled(total)).select("fp").toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    nodes = build_tree(np.sort(sample), max(1, round(total / SHARD)), radius)
    visits = materialize(shard_rows(distinct, nodes, radius), "simhash-visits")
    for k in range(ROUNDS + 1):
        sizes = visits.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("members"), F.min("final").alias("final"))
        large = materialize(sizes.filter(F.col("n") > BLOCK), "simhash-large")
        wanted = large.filter("not final and members > 0").select("shard", "n", "members")
        if k == ROUNDS or wanted.isEmpty():
            break
        finer = subdivided(visits, wanted, radius, SAMPLE, SHARD, BLOCK)
        visits = materialize(visits.join(wanted.select("shard"), "shard", "left_anti").unionByName(finer), "simhash-visits")
    whole = visits.join(large.select("shard"), "shard", "left_anti").select("shard", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", F.when(F.col("home"), 2).otherwise(1).alias("side"))
    # blocks of a shard's members (x) and of its queries (y)
    dealt = visits.join(large.select("shard", F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).alias("m"), F.ceil(F.col("n") / BLOCK).alias("q")), "shard")
    block = lambda count: F.pmod(F.xxhash64("fp"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))
    as_member = dealt.filter("home").select("shard", block("m").alias("x"), every("q").alias("y"), "fp", F.lit(0).alias("side"))
    as_query = dealt.select("shard", every("m").alias("x"), block("q").alias("y"), "fp", F.lit(1).alias("side"))

    def one(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from link_group(group, radius)

    return whole.unionByName(as_member).unionByName(as_query).groupBy("shard", "x", "y").applyInArrow(one, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, over edges (a, b). Nodes have few edges each, so no key is hot.

    Each round takes the least label among neighbours and then that label's own label; labels only fall.
    """
    edges = materialize(edges.filter("a <> b").distinct(), "simhash-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "simhash-labels")
    total = labels.count()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = materialize(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "simhash-step")
        if stepped.filter("label <> old").isEmpty():
            return labels
        wanted = stepped.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = wanted.join(stepped.select(F.col("node").alias("label"), F.col("label").alias("to")), "label")
        labels = materialize(lookup_join(stepped.select("node", "label"), jump, ["label"], "n", total).select("node", F.coalesce("to", "label").alias("label")), "simhash-labels")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for every row of docs.

    component_id is the smallest doc_id reachable over links of radius or fewer differing bits, itself included; it is
    null where only null ids are reachable. Null and empty texts have fingerprint zero and are linked like others. Rows
    that share a doc_id each have their own fingerprint. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, words), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    total = distinct.count()
    labels = components(links(distinct, total, radius))
    named = labels.join(distinct.select(F.col("fp").alias("node"), "least"), "node")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    linked = lookup_join(labels, least, ["label"], "size", total).select(F.col("node").alias("fp"), "component_id")
    table = materialize(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "simhash-components")
    found = lookup_join(rows, table, ["fp"], "n", rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
