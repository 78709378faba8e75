"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import expose_package, materialize, scratch_path, shared_dir

__all__ = ["batches", "byte_text", "expose_package", "gather", "int64", "lookup_join", "materialize", "read_table", "scratch_path", "shared_dir", "texts"]

#: What the contracts call white space.
SPACE = r"[\x20\x09-\x0D]+"
#: A key with more than this share of all rows is resolved by a broadcast lookup; there are at most 1/HOT_SHARE such keys.
HOT_SHARE = 0.001


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (other columns cannot clash), null text as empty."""
    expose_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def int64(column: pa.Array) -> np.ndarray:
    """Of a column without nulls."""
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def byte_text(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def gather(column: pa.Array | pa.ChunkedArray, dtype: str) -> list[np.ndarray]:
    """Binary values as typed arrays, without copying."""
    return [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]


def batches(one: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: pa.Schema | None = None) -> Callable:
    """one, applied to each batch of a task's input, as mapInArrow wants it. A dict is made a batch of the schema."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                made = one(batch)
                yield pa.RecordBatch.from_pydict(made, schema=schema) if isinstance(made, dict) else made

    return run


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, shuffled: bool = False) -> DataFrame:
    """Left join of rows to a table with one row per key, whatever the skew of the keys.

    weight is the table's count of rows for a key and total the sum over keys. Keys heavier than HOT_SHARE of total
    (1,000 at most, by arithmetic) are broadcast; what is left has no heavy key and is joined by a shuffle,
    with `shuffled` also where the table is small, so that a run tells what a larger one takes.
    """
    limit = max(64, int(total * HOT_SHARE))
    hot, cold = table.filter(F.col(weight) > limit), table.filter(F.col(weight) <= limit)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    values = [c for c in table.columns if c not in keys]
    found = marked.filter(F.col("_hot")).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns)
    return found.select(*rows.columns, *values).unionByName(rest.join(cold.hint("merge") if shuffled else cold, keys, "left").select(*rows.columns, *values))
