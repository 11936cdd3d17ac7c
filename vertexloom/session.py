"""Session helpers: lineage cuts in shared storage, and scoped settings."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session on one machine names none, a temporary folder is made and set once. On a cluster none is made: each
    executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master: {master})")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vertexloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; ``release`` deletes it, at the end of the driver's Python at the latest."""
    if not _PATHS:
        atexit.register(release, spark)
    _PATHS.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables so far. DataFrames that operators returned read them, so write or collect those first."""
    while _PATHS:
        path = _PATHS.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            delete(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in shared storage, so a lost executor costs nothing but the read."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def drop_checkpoint(df: DataFrame) -> None:
    """Deletes what ``cut_lineage`` wrote for ``df``, which can't be read any more."""
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if found.isDefined():
        delete(df.sparkSession, found.get())


def written(df: DataFrame, what: str) -> DataFrame:
    """Rows as Parquet in the shared folder, read again: like cut_lineage, but columnar and prunable."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the table that ``written`` gave, which can't be read any more."""
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        delete(df.sparkSession, path)


@contextlib.contextmanager
def settings(spark: SparkSession, **pairs: str) -> Iterator[None]:
    """Session settings (dots as double underscores) that hold inside the block."""
    keys = {k.replace("__", "."): v for k, v in pairs.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
