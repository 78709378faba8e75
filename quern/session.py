"""Session helpers shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def expose_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, local mode takes a temporary one and a cluster,
    whose machines share no such folder, raises RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/quern-{uuid.uuid4().hex[:12]}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is cut, lost executors lose nothing,
    and the Python work above it runs once (Dataset.checkpoint computes a plan twice)."""
    path = scratch_path(df.sparkSession, name)
    _scratch.append((df.sparkSession.sparkContext.applicationId, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: (application, path) of what materialize has written and drop_scratch hasn't deleted, oldest first.
_scratch: list[tuple[str, str]] = []


def scratch_mark() -> int:
    """A place in the sequence of scratch tables, for drop_scratch."""
    return len(_scratch)


def drop_scratch(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> int:
    """Delete this application's scratch tables written since a mark, except the files that `but` reads; their number.

    For results that have been written elsewhere: a DataFrame made from a deleted table can't be computed any more.
    """
    kept = {f.rsplit("/", 1)[0] for f in but.inputFiles()} if but is not None else set()
    own = [(a, p) for a, p in _scratch[since:] if a == spark.sparkContext.applicationId and not any(k.endswith(p.split(":", 1)[-1].lstrip("/")) for k in kept)]
    for _, path in own:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _scratch[since:] = [x for x in _scratch[since:] if x not in own]
    return len(own)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of materialize that nothing reads any more; of an empty one there are no files to find it by."""
    for df in tables:
        places = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for own in [x for x in _scratch if any(p.endswith(x[1].split(":", 1)[-1].lstrip("/")) for p in places)]:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(own[1])
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
            _scratch.remove(own)
