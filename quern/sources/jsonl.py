"""Line-oriented sources and sinks.

Scans keep to Spark's readers, so any store that Spark reaches will do. JSON is parsed by from_json with a given schema;
nothing is inferred from data.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSONL file; blank lines, malformed lines and lines that hold no object are left out."""
    good, _ = parse_lines(spark.read.text(path), schema)
    return good.select("record.*")


def parse_lines(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(raw, record) of lines that hold a JSON object, and (raw, error) of the others; blank lines are neither."""
    corrupt = "_corrupt_record"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    raw = F.regexp_replace("value", f"^{BOM}", "")
    parsed = lines.select(raw.alias("raw")).filter(F.trim("raw") != "").withColumn("record", F.from_json("raw", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    is_object = F.ltrim("raw").startswith("{")
    ok = is_object & F.col(f"record.{corrupt}").isNull()
    good = parsed.filter(ok).select("raw", F.struct(*(F.col(f"record.{f.name}") for f in schema.fields)).alias("record"))
    bad = parsed.filter(~ok).select("raw", F.when(is_object, "malformed").otherwise("no object").alias("error"))
    return good, bad


def scan_matching(spark: SparkSession, path: str, needles: list[str], schema: T.StructType) -> DataFrame:
    """Like scan(), of lines that hold one of the needles; the others aren't parsed."""
    lines = spark.read.text(path)
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(F.col("value"), F.lit(n))
    good, _ = parse_lines(lines.filter(hit), schema)
    return good.select("record.*")


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """(text): lines that aren't blank."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("text"))


def count_lines(spark: SparkSession, path: str) -> int:
    return scan_text(spark, path).count()


#: Names the version folder that readers see.
POINTER = "CURRENT"


def published(spark: SparkSession, folder: str) -> str:
    """The version folder that was published last; FileNotFoundError before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(folder)
    return f"{folder}/{spark.read.text(str(place.toString())).first()[0]}"


def point_to(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version folder the published one, by one rename of the pointer file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pointer, staged = jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/_{POINTER}-{version}")
    fs = pointer.getFileSystem(conf)
    try:
        out = fs.create(staged)
        out.write(bytearray(version, "ascii"))
        out.close()
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf).rename(staged, pointer, options)
    except BaseException:
        fs.delete(staged, True)
        raise


def publish(frames: dict[str, DataFrame], folder: str, overwrite: bool = False) -> str:
    """Write each frame as JSON lines into a new version folder, all or none, and return that.

    What readers see changes at one moment, when the pointer file is replaced by a rename, so a failure before leaves the
    version before, and one after nothing to do. Without overwrite a published folder is an error, before anything is
    written. Frames that aren't given again are not in the new version. Old versions stay until they are deleted.
    """
    spark = next(iter(frames.values())).sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path, version = jvm.org.apache.hadoop.fs.Path, f"v-{time.time_ns()}"
    pointer = path(f"{folder}/{POINTER}")
    fs = pointer.getFileSystem(conf)
    if not overwrite and fs.exists(pointer):
        raise FileExistsError(folder)
    try:
        for name, frame in frames.items():
            frame.write.json(f"{folder}/{version}/{name}")
        point_to(spark, folder, version)
    except BaseException:
        fs.delete(path(f"{folder}/{version}"), True)
        raise
    return f"{folder}/{version}"


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a hash of the set of path|time|size of a binaryFile scan without contents. It is made of sums of the
    stamps' hashes, which don't depend on their order, so nothing is gathered however many files there are."""
    stamp = F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string"))
    parts = [F.sum(F.xxhash64("s", F.lit(k)).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return files.select(stamp.alias("s")).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_files"))


def file_stamps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def fetch(spark: SparkSession, path: str, id_col: str, ids: list) -> DataFrame:
    """Rows by id from a Parquet table; the filter reaches the scan, whose row groups carry the ids' ranges."""
    return spark.read.parquet(path).filter(F.col(id_col).isin(*ids))


def header_of(lines: DataFrame, fields: tuple[str, ...] = ("export_type", "system_id", "schema_version")) -> DataFrame:
    """The header fields of records whose record_type is header."""
    parsed = lines.select(*(F.get_json_object("value", f"$.{f}").alias(f) for f in ("record_type", *fields)))
    return parsed.filter("record_type = 'header'").drop("record_type")


def schema_of(text: str) -> T.StructType:
    """A schema from its JSON form."""
    return T.StructType.fromJson(json.loads(text))
