"""Exact dedup by a tree-merge of sorted digest runs.

Every partition turns its rows into one run: (key, smallest doc_id, rows), sorted by key. Runs then meet in binomial
rounds. In a round, each node takes the runs of FAN children and merges them; equal keys keep the smallest identifier and
add their counts. Runs are cut into FAN ranges of the key (lanes) before the first round and again after each, so lanes
rise ahead of nodes: a task gets FAN runs of a FANth of a partition's keys each, about as much as one partition's run,
and no task ever holds the whole key space, however few the partitions are. The last round leaves one run per lane.

A key is SHA-256 of the normalised text followed by its XXH64. Entries are one only if both agree, which verifies the
identifier that is kept at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, expose_package, int64, lookup_join, materialize

BITS = 3
FAN = 1 << BITS
KEY = "S40"
#: A run is these entries, end to end.
ENTRY = np.dtype([("key", KEY), ("id", "<i8"), ("rows", "<i8")])
NO_ID = np.iinfo(np.int64).max
RUN = "node long, lane long, run binary"
RUN_SCHEMA = pa.schema([("node", pa.int64()), ("lane", pa.int64()), ("run", pa.binary())])
FINAL = "key binary, keep_id long, group_size long"
FINAL_SCHEMA = pa.schema([("key", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 40-byte key of each row. JVM functions only."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(F.col(text_col)).alias("key"))


def key_of(text: Column) -> Column:
    text = normalised(text)
    return F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def fold_entries(entries: np.ndarray) -> np.ndarray:
    """Entries of several sorted runs, merged. The stable sort finds the runs and merges them."""
    if not len(entries):
        return entries
    entries = entries[np.argsort(entries["key"], kind="stable")]
    starts = np.flatnonzero(np.r_[True, entries["key"][1:] != entries["key"][:-1]])
    out = entries[starts].copy()
    out["id"] = np.minimum.reduceat(entries["id"], starts)
    out["rows"] = np.add.reduceat(entries["rows"], starts)
    return out


def lane_of(entries: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of each key."""
    head = np.ascontiguousarray(entries["key"]).view(np.uint8).reshape(len(entries), -1)[:, :8].copy().view(">u8")[:, 0]
    return (head >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(entries), np.int64)


def cut(entries: np.ndarray, node: int, bits: int) -> Iterator[pa.RecordBatch]:
    """One row for each lane that has entries."""
    if not len(entries):
        return
    lanes = lane_of(entries, bits)
    starts = np.flatnonzero(np.r_[True, lanes[1:] != lanes[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(lanes)], strict=True):
        yield pa.RecordBatch.from_pydict({"node": [node], "lane": [int(lanes[a])], "run": [entries[a:b].tobytes()]}, RUN_SCHEMA)


class Run:
    """A run that grows: entries are folded in when as many wait as it holds, so each is moved a few times at most."""

    def __init__(self):
        self.held, self.waiting, self.size = np.empty(0, ENTRY), [], 0

    def add(self, entries: np.ndarray) -> None:
        self.waiting.append(entries)
        self.size += len(entries)
        if self.size >= max(len(self.held), 1 << 16):
            self.fold()

    def fold(self) -> np.ndarray:
        self.held = fold_entries(np.concatenate([self.held, *self.waiting]))
        self.waiting, self.size = [], 0
        return self.held


def first_runs(bits: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Run()
        for batch in source:
            made = np.empty(batch.num_rows, ENTRY)
            made["key"] = np.frombuffer(b"".join(batch.column("key").to_pylist()), KEY)
            made["id"] = int64(batch.column("doc_id").fill_null(NO_ID))
            made["rows"] = 1
            own.add(made)
        yield from cut(own.fold(), TaskContext.get().partitionId(), bits)

    return run


def merged(group: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The runs of a group as one, read as they come."""
    own = Run()
    for batch in group:
        for x in batch.column("run"):
            own.add(np.frombuffer(x.as_buffer(), ENTRY))
    return own.fold()


def merge_round(bits: int):
    """Runs of one lane from FAN children to one run, cut by the next bits."""

    def run(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(merged(group), key[0].as_py(), bits)

    return run


def last_round(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entries = merged(group)
    raw = pa.py_buffer(np.ascontiguousarray(entries["key"]).tobytes())
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(40), len(entries), [None, raw]).cast(pa.binary())
    yield pa.RecordBatch.from_arrays([keys, pa.array(entries["id"], mask=entries["id"] == NO_ID), pa.array(entries["rows"])], schema=FINAL_SCHEMA)


def keepers(keyed: DataFrame) -> DataFrame:
    """One row per key of a (doc_id, key) frame: key, keep_id, group_size."""
    runs = max(1, keyed.rdd.getNumPartitions())
    rounds = max(1, -(-(runs - 1).bit_length() // BITS))
    frame = keyed.mapInArrow(first_runs(BITS), RUN)
    for k in range(1, rounds + 1):
        parents = frame.withColumn("node", F.shiftright("node", BITS)).groupBy("node", "lane")
        frame = parents.applyInArrow(last_round, FINAL) if k == rounds else parents.applyInArrow(merge_round(BITS * (k + 1)), RUN)
    return frame


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and key of every row, with keep_id and group_size where its group has more rows."""
    expose_package(docs.sparkSession)
    keyed = materialize(digests(docs, id_col, text_col), "digests")
    groups = materialize(keepers(keyed).filter("group_size > 1"), "keepers")
    return lookup_join(keyed, groups, ["key"], "group_size", keyed.count())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is replaced by one space; null counts as empty. Rows
    that share a doc_id are one document: each of them counts and each is kept or dropped alike. A null doc_id never
    stays where another row has an id; in a group of null ids alone keep_id is null and kept is true. An empty table
    gives an empty result.
    """
    joined = grouped(docs, id_col, text_col)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of equal texts one row of docs, whole: of those with the smallest id, the first by its columns.

    Rows are decided by their own id and text: rows that share an id but not the text are groups of their own, and of rows
    that repeat both, one stays. A null id comes after all others. Decisions are made on ids and keys; docs are joined
    once, with the rows that go.
    """
    decided = grouped(docs, id_col, text_col).filter("group_size is not null")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    counts = materialize(decided.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), stays.alias("stays")).agg(F.count(F.lit(1)).alias("n")).filter("not stays or n > 1"), "decided")
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (key_of(docs[text_col]) == F.col("_key"))
    kept = docs.join(counts.select("_id", "_key"), same, "left_anti")
    tied = counts.filter("stays").select("_id", "_key")
    if tied.isEmpty():
        return kept
    again = docs.join(tied, same).select("_id", "_key", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return kept.unionByName(again.groupBy("_id", "_key").agg(F.min_by("row", F.to_json(F.struct("row"))).alias("row")).select("row.*"))
