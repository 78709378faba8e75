"""Structured Streaming: incremental sync of a file source, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.operators.incremental import upsert


def sync_files(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: str, hash_col: str, created: str) -> StreamingQuery:
    """New Parquet files of source are merged into target by key and hash; what has run is in the checkpoint.

    Each batch writes a new version below target and then names it current, so a reader never sees half a batch and a
    batch that is run again writes the same version. Of rows with one key in a batch the last by created counts.
    """
    from quern.operators.canonical import last_per_key

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = last_per_key(batch, [key], created)
        before = current(session, target, before=number)
        out = rows if before is None else upsert(before, rows.select(*before.columns), key, hash_col, created)
        out.write.mode("overwrite").parquet(f"{target}/version={number:08d}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The last finished version (with Spark's _SUCCESS) of what sync_files() keeps, or the last before a batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in (fs.globStatus(path(f"{target}/version=*/_SUCCESS")) or [])]
    versions = sorted(p.rsplit("/", 1)[0] for p in found)
    versions = [v for v in versions if before is None or int(v.rsplit("=", 1)[1]) < before]
    return spark.read.parquet(versions[-1]) if versions else None


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows; of a stream, later rows than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n) of session windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    grouped = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
