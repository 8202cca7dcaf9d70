"""Ingestion: budget after whole batches, resumption, batches run again, budgets of sources as state."""

import pytest

from quillstone.plans.store import folder
from quillstone.streaming import ingest


def _files(spark, sizes, start=0, path=None):
    """One file for each list of word counts, in order of time."""
    import time

    path = path or folder(spark, "in")
    for k, words in enumerate(sizes):
        rows = [(start + 100 * k + i, " ".join(["w"] * n), "en", "s", n) for i, n in enumerate(words)]
        spark.createDataFrame(rows, ingest.DOCUMENTS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their times, which are seconds
    return path


def _rows(spark, target):
    return sorted((r.doc_id, r.n_tokens) for r in spark.read.parquet(target).collect())


def test_budget_stops_after_a_full_batch_and_resumes(spark):
    source, target, check = _files(spark, [[3, 2], [4], [5, 0], [6]]), folder(spark, "out"), folder(spark, "check")
    # 5, then 9: the batch that crosses the budget is written whole, the next isn't begun
    assert ingest.ingest_documents(spark, source, target, check, max_tokens=6) == 9
    assert _rows(spark, target) == [(0, 3), (1, 2), (100, 4)]
    # the same budget again takes nothing more
    assert ingest.ingest_documents(spark, source, target, check, max_tokens=6) == 9
    # a larger one goes on where this ended
    assert ingest.ingest_documents(spark, source, target, check, max_tokens=14) == 14
    assert ingest.ingest_documents(spark, source, target, check) == 20
    assert [r.total for r in ingest.ledger(spark, target).orderBy("batch").collect()] == [5, 9, 14, 20]
    assert [n for _, n in _rows(spark, target)] == [3, 2, 4, 5, 0, 6]


def test_killed_run_gives_the_same_rows(spark, monkeypatch):
    source, target, check = _files(spark, [[3], [4], [5]]), folder(spark, "out"), folder(spark, "check")
    calls = []

    class Lost(Exception):
        pass

    from pyspark.sql import DataFrameWriter

    write = DataFrameWriter.json

    def dies(self, path, *a, **k):
        if path.endswith("batch=1") and not calls:
            calls.append(path)
            raise Lost("after the rows of batch 1, before its entry")
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "json", dies)
    with pytest.raises(Exception, match="before its entry"):
        ingest.ingest_documents(spark, source, target, check)
    assert len(_rows(spark, target)) == 2 and ingest.ledger(spark, target).count() == 1
    assert ingest.ingest_documents(spark, source, target, check) == 12
    assert _rows(spark, target) == [(0, 3), (100, 4), (200, 5)]
    assert ingest.ingest_documents(spark, folder_empty(spark), folder(spark, "out"), folder(spark, "check")) == 0


def folder_empty(spark):
    path = folder(spark, "none")
    spark.createDataFrame([], ingest.DOCUMENTS).write.parquet(path)
    return path


def test_budgets_of_sources_are_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path, target, check = folder(spark, "chunks"), folder(spark, "taken"), folder(spark, "check")
    schema = "source string, chunk bigint, tokens bigint"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        taken = ingest.source_budgets(stream, {"a": 10, "b": 5})
        taken.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(target).awaitTermination()

    spark.createDataFrame([("a", 1, 6), ("b", 1, 9), ("c", 1, 1), (None, 1, 1)], schema).coalesce(1).write.parquet(path)
    run()
    spark.createDataFrame([("a", 3, 7), ("a", 2, 5), ("b", 2, 1)], schema).coalesce(1).write.mode("append").parquet(path)
    run()
    got = sorted(map(tuple, spark.read.parquet(target).collect()))
    assert got == [("a", 1, 6, 6), ("a", 2, 5, 11), ("b", 1, 9, 9)]
