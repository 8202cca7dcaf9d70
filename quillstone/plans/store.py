"""Where intermediate tables live: the folder that all executors share.

A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (a
local session, tests) is a folder made here.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; the session's checkpoint folder is set if it was not."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


class _Written(threading.local):
    """Paths of the tables that a thread has written, in order; another thread's jobs may still read theirs."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def written_so_far() -> int:
    """How many tables this thread has written; ``drop_written`` can go back to there."""
    return len(_WRITTEN.paths)


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that this thread has written since, but for the last ``keep`` of them.

    Only for when no result that reads them is still to be computed.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _WRITTEN.paths[since : len(_WRITTEN.paths) - keep]
    for path in gone:
        folder_ = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder_.getFileSystem(conf).delete(folder_, True)
    del _WRITTEN.paths[since : since + len(gone)]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written as Parquet to the shared folder and read from there.

    Cuts lineage: what follows reads files that outlive any executor.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small enough for whole documents; never raises the session's own limit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for jobs that run inside; the session's own limit is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, held)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that are written inside go when a job ends, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def put_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """One small file, written by Hadoop's file system so that any shared store takes it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def folder(spark: SparkSession, name: str) -> str:
    """A path for a new table or file in the shared folder."""
    return f"{shared_dir(spark)}/quillstone/{uuid.uuid4().hex}/{name}"
