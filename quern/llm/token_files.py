"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

Documents are dealt in ranges of doc_id; each task encodes its range and writes one record file:

    record = length (uint64), masked crc32 of those 8 bytes (uint32), payload, masked crc32 of the payload (uint32)
    payload = doc_id (int64), ids before it in its file (uint64), id width in bytes (uint32, NO_ID added for a null doc_id), ids

all little-endian; the mask is ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2^32, crc being zlib's. The index is a Parquet
table beside the files (doc_id, file, offset, length, ids before it, ids) whose rows are committed by Spark: a file of a
lost or repeated attempt is never named in it. The reader opens files by the index, in any order of rows, checks both
checksums of each record and never holds more than a read's worth of records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import expose_package, materialize, scratch_path, texts
from quern.llm.tokens import encoder_for

END_ID = 2
HEAD, FOOT, LEAD = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qQI")
INDEX = "doc_id long, file string, shard int, at long, length long, before long, n_tokens long"
INDEX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("shard", pa.int32()), ("at", pa.int64()), ("length", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64())])
#: Marks a record whose doc_id is null.
NO_ID = 1 << 31
#: Bytes that the reader asks for at a time, if no single record is longer.
READ_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + FOOT.pack(masked(length)) + payload + FOOT.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    """The payload of one record; a wrong length or checksum raises ValueError."""
    length, crc = HEAD.unpack_from(record)
    payload = record[HEAD.size : HEAD.size + length]
    if crc != masked(record[:8]) or len(record) != HEAD.size + length + FOOT.size or FOOT.unpack_from(record, HEAD.size + length)[0] != masked(payload):
        raise ValueError("a record is damaged")
    return payload


def payload_of(doc_id: int | None, before: int, ids: bytes, width: int) -> bytes:
    return (LEAD.pack(0, before, width | NO_ID) if doc_id is None else LEAD.pack(doc_id, before, width)) + ids


def parse(payload: bytes) -> tuple[int | None, int, np.ndarray]:
    """doc_id, ids before it in its file, and its ids."""
    doc_id, before, width = LEAD.unpack_from(payload)
    return None if width & NO_ID else doc_id, before, np.frombuffer(payload, f"<u{width & ~NO_ID}", offset=LEAD.size)


def writer(folder: str, run_id: str, tokenizer_path: str, end_id: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        encoder = encoder_for(tokenizer_path, end_id)
        shard, name, out, at, before = TaskContext.get().partitionId(), "", None, 0, 0
        try:
            for batch in source:
                if batch.num_rows and out is None:
                    name = f"{run_id}-{shard:06d}-{uuid.uuid4().hex}.rec"
                    out = store.open_output_stream(f"{root}/{name}")
                rows = {c: [] for c in INDEX_SCHEMA.names}
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encoder(text) + encoder.end
                    record = frame(payload_of(doc_id, before, ids, encoder.width))
                    out.write(record)
                    n = len(ids) // encoder.width
                    for c, v in zip(INDEX_SCHEMA.names, (doc_id, name, shard, at, len(record), before, n), strict=True):
                        rows[c].append(v)
                    at, before = at + len(record), before + n
                yield pa.RecordBatch.from_pydict(rows, INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return run


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, run_id: str = "part") -> DataFrame:
    """Write the record files and return their index, whose before column counts within a file. Names of files begin with
    the run's id, which must differ where corpora share a folder.

    Files follow each other in ascending doc_id by their shard number. Null doc_ids come first.
    """
    rows = texts(docs)
    parts = max(rows.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return materialize(dealt.mapInArrow(writer(folder, run_id, tokenizer_path, end_id), INDEX), "token-index")


def global_starts(index: DataFrame) -> DataFrame:
    """The index with start, the ids of all documents before: one total for each file is added up on the driver."""
    totals = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    starts, at = [], 0
    for r in totals:
        starts.append((r["file"], at))
        at += r["n"]
    table = index.sparkSession.createDataFrame(starts, "file string, base long")
    return index.join(F.broadcast(table), "file").withColumn("start", F.col("base") + F.col("before"))


def reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        name, handle = None, None
        held, held_at = b"", 0
        for batch in source:
            rows = {c: [] for c in schema.names}
            for doc_id, file, at, length, before, start in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "file", "at", "length", "before", "start")), strict=True):
                if file != name:
                    if handle is not None:
                        handle.close()
                    name, handle, held = file, store.open_input_file(f"{root}/{file}"), b""
                if not held_at <= at <= at + length <= held_at + len(held):
                    handle.seek(at)
                    held, held_at = handle.read(max(length, READ_BYTES)), at
                kept, inside, ids = parse(unframe(held[at - held_at : at - held_at + length]))
                if inside != before or kept != doc_id:
                    raise ValueError(f"{file} and the index differ at {at}")
                for c, v in zip(schema.names, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema)
        if handle is not None:
            handle.close()

    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files that the index (with start) names."""
    return index.mapInArrow(reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def drop_orphans(index: DataFrame, folder: str, run_id: str = "part") -> int:
    """Delete record files of a run that its index doesn't name (of lost attempts); their number. Other runs' files stay.
    The index has a file for each task."""
    store, root = pafs.FileSystem.from_uri(folder)
    named = {r["file"] for r in index.select("file").distinct().toLocalIterator()}
    found = [x.path for x in store.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith(f"{run_id}-") and x.base_name.endswith(".rec") and x.base_name not in named]
    for path in found:
        store.delete_file(path)
    return len(found)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode every whole text, write the files, read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are records of their own, next to each other.
    An empty table writes no file and gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    expose_package(spark)
    folder = folder or scratch_path(spark, "records")
    run_id = uuid.uuid4().hex[:12]
    index = write_records(docs, folder, tokenizer_path, end_id, run_id)
    drop_orphans(index, folder, run_id)
    return read_records(global_starts(index), folder)
