"""Publishing: staged writes, a manifest of digests, one atomic switch; promotion file by file with a status each.

A published folder holds versions and a small file ``CURRENT`` that names one.
A version is written under its own name and digested before the switch, which
is one rename over ``CURRENT``: readers see the old version or the new one,
and a run that is lost before the switch leaves the old one standing.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.store import put_bytes, written
from quillstone.sources.token_shards import _opened

MANIFEST = "file string, length bigint, sha256 string"


def _files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(file, length[, sha256]) of all data files below a folder; names are relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.expr(f"substring(path, instr(path, '{path.rstrip('/').rpartition('/')[2]}/') + {len(path.rstrip('/').rpartition('/')[2]) + 1})"), "%20", " ")
    return found.select(name.alias("file"), "length", *([F.sha2("content", 256).alias("sha256")] if content else []))


def _rename_over(spark: SparkSession, source: str, target: str) -> None:
    """One rename that replaces the target, by Hadoop's file context."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    path = jvm.org.apache.hadoop.fs.Path
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(path(source), path(target), options)


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that is published, or None."""
    try:
        row = spark.read.text(f"{path}/CURRENT").first()
    except Exception as error:  # nothing was published
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return f"{path}/versions/{row.value}" if row else None


def stage(rows: DataFrame, path: str) -> str:
    """Writes a version with its manifest; its name.  Readers don't see it yet."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/versions/{name}/data")
    _files(spark, f"{path}/versions/{name}/data", True).coalesce(1).write.json(f"{path}/versions/{name}/manifest")
    return name


def switch(spark: SparkSession, path: str, name: str) -> None:
    put_bytes(spark, f"{path}/CURRENT.{name}", name.encode())
    _rename_over(spark, f"{path}/CURRENT.{name}", f"{path}/CURRENT")


def publish(rows: DataFrame, path: str) -> str:
    """Stages a version, checks it against its manifest, and switches to it; its name."""
    name = stage(rows, path)
    bad = verify(rows.sparkSession, f"{path}/versions/{name}").where("status <> 'ok'").first()
    if bad is not None:
        raise RuntimeError(f"{bad.file} is {bad.status}")
    switch(rows.sparkSession, path, name)
    return name


def read(spark: SparkSession, path: str) -> DataFrame:
    held = current(spark, path)
    if held is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    return spark.read.parquet(f"{held}/data")


def verify(spark: SparkSession, version: str) -> DataFrame:
    """(file, status) of a version: ok, changed, missing, or unlisted."""
    listed = spark.read.schema(MANIFEST).json(f"{version}/manifest").select("file", F.col("sha256").alias("said"))
    there = _files(spark, f"{version}/data", True).select("file", "sha256")
    status = F.when(F.col("said").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("said") == F.col("sha256"), "ok").otherwise("changed")
    return listed.join(there, "file", "full").select("file", status.alias("status"))


def promote(spark: SparkSession, source: str, target: str, force: bool = False) -> DataFrame:
    """Copies the files of a folder to another; (file, length, status): copied, skipped because it was there, or replaced if ``force``.

    Tasks copy, each file under a name of its own and renamed when it is whole,
    so a task that is run again leaves one file.  Files are opened by Arrow's
    file systems.
    """
    plan = _files(spark, source)

    def copy(batches):
        (fs, root), (to, into) = _opened(source), _opened(target)
        for batch in batches:
            status = []
            for name in batch.column(0).to_pylist():
                there = to.get_file_info(f"{into}/{name}").type == pafs.FileType.File
                status.append("skipped" if there and not force else "replaced" if there else "copied")
                if status[-1] == "skipped":
                    continue
                staged = f"{into}/{name}.{uuid.uuid4().hex}.tmp"
                to.create_dir(staged.rpartition("/")[0], recursive=True)
                with fs.open_input_stream(f"{root}/{name}") as a, to.open_output_stream(staged) as b:
                    while part := a.read(1 << 20):
                        b.write(part)
                to.move(staged, f"{into}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(status, pa.string())], names=["file", "length", "status"])

    # written: the copies are made once, whatever is asked of the statuses later
    return written(plan.repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(copy, "file string, length bigint, status string"), "statuses")
