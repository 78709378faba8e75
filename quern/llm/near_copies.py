"""Near copies by SimHash, vantage-point trees and the Jaccard similarity of word shingles.

Texts with equal sets of shingles are one node, and a node has the SimHash fingerprint of its set. Candidates are nodes
whose fingerprints vantage-point trees link (simhash.links), a bucket for each component of those links. Copies that are
as similar as SIMILAR often lie further apart than such trees can look, so nodes that share a band of minhashes are
candidates beside them: with BANDS bands of ROWS hashes a pair of similarity s is missed with probability
(1 - s ** ROWS) ** BANDS, 1.3e-7 at 0.8. Each candidate pair is confirmed by the exact similarity of its sets before it
counts as a link:

* Each member of a bucket is compared with the one that has most company over all its buckets: of edited copies that is
  the original or what is nearest to it, which buckets of one group share. What that links is contracted.
* Then members of a bucket whose components still differ are compared, so no link in a bucket is lost. A bit for each
  residue of shingles, set if a text has an odd number of them, differs between two texts for no more residues than they
  have different shingles, so pairs with too many different bits are no links and no row is made of them. Nor of those
  that agree in fewer than LEAST_EQUAL of all minhashes (by a byte of each), which tells where sets are far larger than
  PARITIES: a pair at 0.8 has as few with probability 4e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import byte_text, lookup_join, materialize, texts
from quern.llm.simhash import BLANKS, LOWER, SEED, components
from quern.llm.simhash import links as fingerprint_links
from quern.session import discard, drop_scratch, scratch_mark

WORDS = 5
#: Least similarity of a link, as a fraction of whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 5
#: Shingles hashed at a time.
SLICE = 1 << 11
#: Texts whose sets are held at a time.
TEXTS = 256
#: Of BANDS * ROWS minhashes, those that a pair must share.
LEAST_EQUAL = 124
#: Residues of shingles whose parities are kept, a bit each.
PARITIES = 1024
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
TERMS = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
SKETCHES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])
#: Members of a bucket that meet in one cell.
BLOCK = 256


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a UTF-8 text, ascending. Fewer words than a shingle's are one shingle."""
    parts = [p for p in text.translate(LOWER).translate(BLANKS).split(b" ") if p]
    if len(parts) < words:
        made = {b" ".join(parts)}
    else:
        made = set(map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)))
    found = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in made), np.uint64, len(made))
    found.sort()
    return found


def set_fingerprint(shingles: np.ndarray) -> int:
    """Bit b is set if over half of the hashes have it, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(shingles), 1 << 16):
        ones += np.unpackbits(shingles[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def band_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, from the least values of the band's hash functions, and a byte of each value, eight to a long."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), SLICE):
        np.minimum(least, (shingles[a : a + SLICE, None] * FACTORS + TERMS).min(axis=0), out=least)
    own = least.reshape(BANDS, ROWS)
    keys = np.fromiter((xxhash.xxh64_intdigest(own[b].tobytes(), b) for b in range(BANDS)), np.uint64, BANDS)
    # the high bytes of least values are all small, the low ones are as good as random
    return keys.view(np.int64), np.ascontiguousarray(least.view(np.uint8).reshape(-1, 8)[:, 0]).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each residue has an odd number of the shingles, 64 to a long."""
    odd = np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def hash_of(text: Column) -> Column:
    """Tells texts of rows with one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, node (hash of the set), fp, size, bands, signature and parity of every row and whole text; null counts as empty."""

    def one(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, words) for t in byte_text(batch.column("text"))]
        keys = [band_keys(s) for s in sets]
        nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets))
        return {
            "doc_id": batch.column("doc_id"),
            "text_hash": batch.column("text_hash"),
            "node": nodes.view(np.int64),
            "fp": [set_fingerprint(s) for s in sets],
            "size": [len(s) for s in sets],
            "bands": [b for b, _ in keys],
            "signature": [g for _, g in keys],
            "parity": [parities(s) for s in sets],
        }

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for a in range(0, batch.num_rows, TEXTS):
                yield pa.RecordBatch.from_pydict(one(batch.slice(a, TEXTS)), schema=SKETCHES)

    return texts(docs, hash_of(F.col("text")).alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, node long, fp long, size int, bands array<long>, signature array<long>, parity array<long>")


def sets_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the wanted nodes. Sets are made again from one text of each: only those texts are moved."""
    named = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "shingles": [shingle_set(t, words).view(np.int64) for t in byte_text(part.column("text"))]}, schema=schema)

    own = texts(docs, hash_of(F.col("text")).alias("text_hash")).select("text", "text_hash").join(named.hint("merge"), "text_hash").dropDuplicates(["text_hash"])
    return own.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def can_be_similar(x: str, y: str) -> Column:
    """Of two set sizes: whether the smaller one within the larger one would do."""
    part, whole = SIMILAR
    return F.least(x, y) * whole >= F.greatest(x, y) * part


def can_be_linked(size_x: str, x: str, size_y: str, y: str) -> Column:
    """Of two sets' sizes and parities: whether they may be SIMILAR. Sets have at least as many different shingles as
    parities; with d of those and s in both sizes together their similarity is (s - d) / (s + d)."""
    part, whole = SIMILAR
    different = F.lit(0)
    for k in range(PARITIES // 64):
        different = different + F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k]))
    return different * (whole + part) <= (F.col(size_x) + F.col(size_y)) * (whole - part)


def equal_minhashes(x: str, y: str) -> Column:
    """Bytes that two signatures share: all less those that differ, of which one bit is left in each byte."""

    def differing(a: Column, b: Column) -> Column:
        bits = a.bitwiseXOR(b)
        for shift in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        return F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(BANDS * ROWS) - F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda total, n: total + n)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets (node, shingles) are similar enough, written. b may be hot."""
    part, whole = SIMILAR
    pairs = materialize(pairs.select("a", "b").distinct(), "near-pairs")
    by_b = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    right = by_b.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    found = lookup_join(pairs, right, ["b"], "n", pairs.count()).drop("n")
    found = found.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    # s >= part / whole, where s = shared / (|a| + |b| - shared)
    links = materialize(found.filter(shared * (part + whole) >= (F.size("of_a") + F.size("of_b")) * part).select("a", "b"), "near-links")
    discard(pairs)
    return links


def in_cells(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of buckets, each in one block of its bucket (column `own`) and in a copy for each block that it meets (`other`),
    so that no task holds more than two blocks however large a bucket is."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = rows.join(sizes, "band").withColumn(own, F.pmod(F.xxhash64("node"), blocks).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), blocks - 1))).drop("members")


def open_members(inside: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, node, size, label, members) of buckets whose members are in different components, and (band, members)."""
    labelled = inside.select("band", F.col("a").alias("node"), "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members")).filter("low <> high").select("band", "members")
    found = materialize(labelled.join(mixed, "band"), "near-open")
    return found, found.select("band", "members").distinct()


def fingerprint_buckets(distinct: DataFrame) -> DataFrame:
    """(node, size, band) of nodes (node, size, fp) whose fingerprints are linked with others, or the same as others': a bucket
    for each component."""
    points = materialize(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "near-fingerprints")
    labels = components(fingerprint_links(points, points.count()))
    placed = points.join(labels.withColumnRenamed("node", "fp"), "fp", "left").filter("label is not null or n > 1")
    table = materialize(placed.select("fp", "n", F.xxhash64(F.lit("fingerprints"), F.coalesce("label", "fp")).alias("band")), "near-trees")
    return lookup_join(distinct.select("node", "size", "fp"), table, ["fp"], "n", distinct.count()).filter("band is not null").select("node", "size", "band")


def company(members: DataFrame, total: int) -> DataFrame:
    """(band, a, size, b, size_b) of members (node, size, band) of buckets of two or more. b is the member whose buckets
    have most members in all, itself included."""
    counts = materialize(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-bands")
    shared = materialize(lookup_join(members, counts, ["band"], "n", total).filter("n is not null"), "near-shared")
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    most = shared.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", "node", "size")).alias("one"), F.first("n").alias("n"))
    chosen = materialize(most.select("band", F.col("one.node").alias("b"), F.col("one.size").alias("size_b"), "n"), "near-chosen")
    inside = lookup_join(shared.drop("n"), chosen, ["band"], "n", total)
    inside = materialize(inside.select("band", F.col("node").alias("a"), "size", "b", "size_b"), "near-buckets")
    discard(counts, shared, chosen)
    return inside


def near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, component_id, text_hash and component for every row of docs.

    component_id is the smallest doc_id reachable over links of similarity SIMILAR or more, itself included; it is null
    where only null ids are reachable; component is a number of the component, never null. Texts without a word are
    alike. An empty table gives an empty result.
    """
    rows = materialize(sketches(docs, words), "near-sketches")
    distinct = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("parity").alias("parity")), "near-distinct")
    total = distinct.count()
    members = distinct.select("node", "size", F.explode("bands").alias("band")).unionByName(fingerprint_buckets(distinct))
    inside = company(members, total * (BANDS + 1))
    wanted = inside.filter("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(sets_of(docs, rows, wanted, words), "near-sets")  # of all that share a bucket: texts are moved once
    links = confirmed(inside.filter(can_be_similar("size", "size_b") & (F.col("a") != F.col("b"))), sets)
    labels = components(links)

    # what is left: members of a bucket in different components
    open_, sizes = open_members(inside, labels)
    signed = materialize(open_.drop("members").join(distinct.select("node", "signature", "parity"), "node"), "near-signed")
    x = in_cells(signed, sizes, "x", "y").withColumnRenamed("node", "a")
    y = in_cells(signed, sizes, "y", "x").select("band", "x", "y", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("label").alias("label_b"), F.col("signature").alias("signature_b"), F.col("parity").alias("parity_b"))
    similar = can_be_similar("size", "size_b") & can_be_linked("size", "parity", "size_b", "parity_b") & (equal_minhashes("signature", "signature_b") >= LEAST_EQUAL)
    crossing = x.join(y, ["band", "x", "y"]).filter((F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b")) & similar)
    labels = components(links.unionByName(confirmed(crossing, sets)))
    discard(inside, open_, signed, sets)

    named = labels.join(distinct.select("node", "least"), "node")
    sizes = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    linked = lookup_join(labels, sizes, ["label"], "size", total).select("node", "component_id", "label")
    made = distinct.join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("label", "node").alias("component"), "n")
    table = materialize(made, "near-components")
    return lookup_join(rows.select("doc_id", "text_hash", "node"), table, ["node"], "n", rows.count()).select("doc_id", "component_id", "text_hash", "component")


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs without those that near_copies finds to be another's: of each component the text with the smallest
    doc_id stays (then the smallest hash; a null doc_id comes last), whatever other rows share its doc_id. Rows that
    repeat doc_id and text go or stay together."""
    begin = scratch_mark()
    found = materialize(near_copies(docs, words), "near-found")
    drop_scratch(docs.sparkSession, begin, but=found)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = lookup_join(found, best, ["component"], "size", found.count()).filter("best is not null")
    dropped = sized.filter(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(dropped.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (hash_of(docs["text"]) == F.col("_hash")), "left_anti")
