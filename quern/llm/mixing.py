"""Mixing sources to target weights by Pfair scheduling.

A source with weight w owns blocks 0, 1, 2, ... of its documents. Block j is released at floor(j / w) and due at
ceil((j + 1) / w). One block fills one slot; in each slot the released block with the earliest deadline runs. On one
sequence with weights that add up to 1, that meets every deadline, so after t slots a source is less than one block off
w * t. Weights are taken as given, as fractions, and every slot is worked out, so nothing is rounded and no error adds
up. A schedule has MOST_BLOCKS blocks or about as many, whatever the table's size: a block is BLOCK_ROWS documents or, of
larger tables, an even share of all, so that the driver's work and the plan it broadcasts are bounded. When a source runs
out of blocks, a new phase begins in which the others share its weight in proportion; there are at most as many phases as
sources.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import count
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import expose_package, materialize

#: Blocks of a source in one row of the plan, documents in a block at least, and blocks of a schedule (at most one more
#: for each source).
PERIOD = 512
BLOCK_ROWS = 16
MOST_BLOCKS = 1 << 20
#: Weights are of sources named by the caller or found in the data; more than these are refused, not cut.
MOST_SOURCES = 1_000
NO_SOURCE = "\0none"


def pfair(parts: dict[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, release, deadline) of each slot, without end: earliest deadline first among released blocks; ties
    by name. A source's weight is its parts over the sum of parts, exactly."""
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    for t in count():
        while waiting and waiting[0][0] <= t:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[s]), s, j, release))
        due, s, j, release = heapq.heappop(ready)
        assert due > t, "a deadline was missed"
        yield s, j, release, due
        heapq.heappush(waiting, ((j + 1) * period // parts[s], s, j + 1))


def exact_parts(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> Iterator[dict]:
    """Runs of a source's blocks, none over a multiple of period or the end of a phase: first and last block, first slot, and of
    each block its slot (places), release and deadline from there."""
    left, first, at = dict(blocks), dict.fromkeys(blocks, 0), 0
    while left := {s: n for s, n in left.items() if n > 0}:
        runs: dict[str, dict] = {}
        # the phase ends with the slot that takes some source's last block
        for slot, (s, j, release, due) in enumerate(pfair(exact_parts({s: weights[s] for s in left}))):
            block = first[s] + j
            if s not in runs or block % period == 0:
                if s in runs:
                    yield runs[s]
                runs[s] = {"source_key": s, "first_block": block, "first_slot": at + slot, "period": period, "places": [], "releases": [], "deadlines": []}
            run = runs[s]
            base = run["first_slot"] - at
            run["places"].append(slot - base)
            run["releases"].append(release - base)
            run["deadlines"].append(due - base)
            run["last_block"], run["parts"] = block, len(run["places"])
            left[s] -= 1
            if not left[s]:
                break
        yield from runs.values()
        at += slot + 1
        for s, run in runs.items():
            first[s] = run["last_block"] + 1


def ranked(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """doc_id, source_key and the row's rank within its source by doc_id, and the rows of each source, without a window over a source: rows are
    dealt in ranges of (source, doc_id), numbered within their partition, and partition counts are added up."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source_key"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartitionByRange(parts, "source_key", "doc_id").sortWithinPartitions("source_key", "doc_id")
    marked = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "mixing-order")
    marked = marked.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    # a row or two for each partition, as partitions are ranges of sources
    counts = marked.groupBy("source_key", "part").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    before: dict[str, int] = {}
    offsets = []
    for r in sorted(counts, key=lambda r: (r["part"], r["source_key"])):
        offsets.append((r["source_key"], r["part"], before.get(r["source_key"], 0) - r["least"]))
        before[r["source_key"]] = before.get(r["source_key"], 0) + r["n"]
    table = spark.createDataFrame(offsets, "source_key string, part long, shift long")
    return marked.join(F.broadcast(table), ["source_key", "part"]).select("doc_id", "source_key", (F.col("place") + F.col("shift")).alias("rank")), before


def plan_table(spark: SparkSession, plan: Iterator[dict], period: int) -> DataFrame:
    """The runs of a plan, with the chunk of blocks that each lies in."""
    names = ["source_key", "first_block", "last_block", "first_slot", "places", "releases", "deadlines"]
    lists = {name: [] for name in names}
    for run in plan:
        for name in names:
            lists[name].append(np.array(run[name], np.int64) if isinstance(run[name], list) else run[name])
    longs = pa.list_(pa.int64())
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), longs, longs, longs]
    table = spark.createDataFrame(pa.table({n: pa.array(lists[n], t) for n, t in zip(names, types, strict=True)}))
    return table.withColumn("chunk", F.expr(f"first_block div {period}"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int | None = None, period: int = PERIOD) -> DataFrame:
    """Every row of docs with its place in the mixture: doc_id, source, block, release, deadline, slot, position.

    weights: target weights by source; those not named get a millionth of the least given; by default a
    source weighs the square root of its rows. block_rows: documents in a block; by default BLOCK_ROWS or, where that
    makes more than MOST_BLOCKS blocks, rows / MOST_BLOCKS. release and deadline are slots counted from the start of the sequence,
    in the phase that the block falls in, by the weights as given. position is slot * block_rows + place in the block, unique for each row and
    ascending in mixture order (a source's last block may be shorter, so positions can skip). Rows with a null source
    form a source of their own. Equal doc_ids get neighbouring places. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    expose_package(spark)
    rows, totals = ranked(docs)
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"{len(totals)} sources; mix() takes {MOST_SOURCES}")
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(totals.values()) // MOST_BLOCKS))
    given = weights or {s: n**0.5 for s, n in totals.items()}
    least = min([w for w in given.values() if w > 0], default=1.0) * 1e-6
    plan = phases({s: -(-n // block_rows) for s, n in totals.items()}, {s: max(given.get(s, 0.0), least) for s in totals}, period)
    table = plan_table(spark, plan, period)
    rows = rows.withColumn("block", F.expr(f"rank div {block_rows}")).withColumn("chunk", F.expr(f"rank div {block_rows * period}"))
    inside = (rows.source_key == table.source_key) & (rows.chunk == table.chunk) & (F.col("block") >= F.col("first_block")) & (F.col("block") <= F.col("last_block"))
    found = rows.join(table, inside).drop(table.source_key).withColumn("j", F.expr("int(block - first_block) + 1"))
    slot, release, due = (F.col("first_slot") + F.expr(f"element_at({c}, j)") for c in ("places", "releases", "deadlines"))
    found = found.withColumn("slot", slot)
    source = F.when(F.col("source_key") != NO_SOURCE, F.col("source_key"))
    position = F.expr(f"slot * {block_rows} + rank % {block_rows}")
    return found.select("doc_id", source.alias("source"), "block", release.alias("release"), due.alias("deadline"), "slot", position.alias("position"))
