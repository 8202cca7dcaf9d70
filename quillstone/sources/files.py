"""Text, JSON, CSV, Markdown and raw-token sources, and the sinks that match them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVAL_SCHEMA = T.StructType([T.StructField("step", T.LongType()), T.StructField("val_loss", T.DoubleType()), T.StructField("val_bpb", T.DoubleType()), T.StructField("lr", T.DoubleType()), T.StructField("train_loss", T.DoubleType()), T.StructField("grad_norm", T.DoubleType())])


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, text): files cut at blank lines, blocks stripped, empty ones dropped."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    blocks = files.select("path", F.posexplode_outer(F.split("value", r"\n\s*\n", -1)).alias("block", "text"))
    return blocks.select("path", "block", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")


def metrics_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation rows and log rows of one JSON-lines file, told apart by the keys they have."""
    rows = spark.read.schema(EVAL_SCHEMA).json(path)
    return rows.where("val_bpb is not null"), rows.where("train_loss is not null")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """(path, section_no, title, body): Markdown cut at second-level headings outside fenced code."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))
    from pyspark.sql import Window

    so_far = Window.partitionBy("path").orderBy("line_no")
    fenced = F.sum(F.col("line").startswith("```").cast("int")).over(so_far) % 2 == 1
    lines = lines.withColumn("head", (~fenced & F.col("line").startswith("## ")).cast("int")).withColumn("section_no", F.sum("head").over(so_far))
    grouped = lines.groupBy("path", "section_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return grouped.select("path", "section_no", F.when(F.col("section_no") > 0, F.expr("substring(ls[0].line, 4)")).alias("title"), F.array_join(F.col("ls.line"), "\n").alias("body"))


def numbered_runs(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, by the number at the end of their folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.withColumn("number", F.regexp_extract("path", r"(\d+)/[^/]*$", 1).try_cast("bigint")).orderBy("number", "path")


def uint16_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, token) of raw little-endian 16-bit files."""
    import numpy as np
    import pyarrow as pa

    def kernel(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2")
                for lo in range(0, len(ids), 1 << 16):
                    part = ids[lo : lo + (1 << 16)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(lo, lo + len(part))), pa.array(part)], names=["path", "pos", "token"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "path string, pos bigint, token int")


def write_archives(rows: DataFrame, path: str, kinds: dict[str, str]) -> None:
    """Rows as compressed archives of one array a column, each of a batch's rows; held in a Parquet table of blobs, which any store takes."""
    import io

    import numpy as np
    import pyarrow as pa

    def kernel(batches):
        for batch in batches:
            held = io.BytesIO()
            np.savez_compressed(held, **{name: np.array(batch.column(i).to_pylist(), kind) for i, (name, kind) in enumerate(kinds.items())})
            yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], names=["archive"])

    rows.select(*kinds).mapInArrow(kernel, "archive binary").write.parquet(path)


def read_archives(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of ``write_archives``, columns in the order of ``schema``."""
    import io

    import numpy as np
    import pyarrow as pa

    names = [part.split()[0] for part in schema.split(", ")]

    def kernel(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                with np.load(io.BytesIO(raw), allow_pickle=False) as held:
                    yield pa.RecordBatch.from_arrays([pa.array(held[n].tolist()) for n in names], names=names)

    return spark.read.schema("archive binary").parquet(path).mapInArrow(kernel, schema)


def write_shards(tokens: DataFrame, path: str) -> None:
    """Token rows (split, shard, ...) as one folder per split and shard; written whole or not at all."""
    tokens.write.mode("overwrite").partitionBy("split", "shard").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file, for integrity checks."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
