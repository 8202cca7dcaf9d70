"""The driver's tables, with their schemas stated rather than inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed: names of the tables under a scale-factor folder.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Tables whose rows cost much to work on, and may come in one small file.
_HEAVY = {"documents", "pages", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder; only Spark's readers touch the path.

    A heavy table that is read in fewer than 16 partitions, and so is small, is
    dealt out over 64 cores at most; larger ones stay as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _HEAVY and df.rdd.getNumPartitions() < min(cores, 16):
        return df.repartition(min(cores, 64))
    return df


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the named tables (all, if none is named)."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
