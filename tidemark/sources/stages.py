"""Stages that end a lineage: frames written to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below that which driver and executors share. A local session
    without one gets its own; on a cluster a machine's own folder would lose rows, so that raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return f"{path}/tidemark-{spark.sparkContext.applicationId}"


_lock, _inside = threading.Lock(), [0, None]


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession):
    """Jobs in here drop their shuffle files when they end: what they wrote is all that's needed.
    The setting is the session's, so the last of several threads puts it back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _lock:
        if not _inside[0]:
            _inside[1] = spark.conf.get(key)
            spark.conf.set(key, "true")
        _inside[0] += 1
    try:
        yield
    finally:
        with _lock:
            _inside[0] -= 1
            if not _inside[0]:
                spark.conf.set(key, _inside[1])


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_scopes = threading.local()


@contextlib.contextmanager
def stages_dropped(spark: SparkSession):
    """What staged and bucketed write in here goes at the end, but for what kept gives. For callers
    that write their result inside; a frame that is used later must not depend on it."""
    open_ = _scopes.__dict__.setdefault("open", [])
    open_.append([])
    try:
        yield
    finally:
        for kind, name in open_.pop():
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                remove(spark, name)


def _note(kind: str, name: str) -> None:
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append((kind, name))


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, so a lost
    executor costs no recomputation, and Spark knows the size of what it reads."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    _note("path", path)
    return written(df, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """As staged, in a folder that the caller removes."""
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """As staged, for a result that outlives the scope it is written in."""
    out = staged(df)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].pop()
    return out


def bucketed(df: DataFrame, by: str, **options) -> DataFrame:
    """As staged, in a table with a bucket for each shuffle partition: joins and groups by that
    column read it as it lies, without another shuffle. options: the writer's."""
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _note("path", path)
    _note("table", name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_end(spark):
        df.write.options(**options).bucketBy(buckets, by).option("path", path).saveAsTable(name)
    return spark.table(name)
