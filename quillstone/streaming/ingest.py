"""Streaming ingestion: documents arrive in files, a token budget ends it; budgets of sources as state; event windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import normalized_words

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


#: What the ledger says of each batch: its own tokens and documents, and the tokens of all batches up to it.
LEDGER = "batch bigint, tokens bigint, docs bigint, total bigint"


class BudgetReached(Exception):
    """Ends a run before the batch that would begin beyond the budget; that batch stays to be done."""


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """(batch, tokens, docs, total) of every batch that was written; none before the first."""
    try:
        return spark.read.schema(LEDGER).json(f"{target}_ledger")
    except Exception as error:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def ingest_documents(spark: SparkSession, source: str, target: str, checkpoint: str, max_tokens: int | None = None, files_per_batch: int = 1) -> int:
    """New files of ``source`` are counted and appended to ``target``; returns the tokens now there.

    The budget is tested before each batch, as batches are written whole: the
    one that crosses it is the last.  The run then ends, and files beyond it are
    left unread; a later run with a larger budget goes on with them.  A restart
    goes on where the checkpoint left off.

    What a batch is worth is written to the ledger after its rows, with the sum
    so far; the next batch reads that one entry, so no batch reads the target.
    Rows and entry lie in folders of the batch's number: a batch that is run again,
    because it or its commit was lost, replaces both by the same.
    """
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    counted = stream.select("doc_id", "text", F.size(normalized_words(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_tokens"))

    def before(number: int) -> int:
        if number == 0:
            return 0
        return spark.read.schema("total bigint").json(f"{target}_ledger/batch={number - 1}").first().total

    def write(batch: DataFrame, number: int) -> None:
        held = before(number)
        if max_tokens is not None and held >= max_tokens:
            raise BudgetReached(f"batch {number} begins at {held} tokens")
        path = f"{target}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        # counted from what was written
        done = spark.read.schema("n_tokens bigint").parquet(path).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("docs"))
        done.select("tokens", "docs", (F.lit(held) + F.col("tokens")).alias("total")).coalesce(1).write.mode("overwrite").json(f"{target}_ledger/batch={number}")

    query = counted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as error:
        if BudgetReached.__name__ not in str(error):
            raise
    return ledger(spark, target).agg(F.max("total")).first()[0] or 0


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows by event type; later rows than the watermark are dropped in a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "events")


def source_budgets(chunks: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """A stream of (source, chunk, tokens) -> (source, chunk, tokens, total) of the chunks that their source's budget takes.

    Each source's tokens so far are a state of the query's store, so a restart
    goes on with them.  A chunk is taken whole if its source's total is below
    the budget before it; chunks of one trigger are taken in order of number.
    ``chunks`` are sums over many documents, made before they meet here, so a
    source with a third of all documents is no large group.  Sources without a
    budget, and null ones, are not taken; repeated chunks count each.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    schema = "source string, chunk bigint, tokens bigint, total bigint"

    class Taken(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.total = handle.getValueState("total", "total bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            budget = budgets.get(key[0], 0)
            held = self.total.get()[0] if self.total.exists() else 0
            out = []
            for chunk, tokens in sorted((int(c), int(t)) for frame in rows for c, t in zip(frame["chunk"], frame["tokens"], strict=True)):
                if held >= budget:
                    break
                held += tokens
                out.append((key[0], chunk, tokens, held))
            self.total.update((held,))
            yield pd.DataFrame(out, columns=["source", "chunk", "tokens", "total"])

        def close(self) -> None:
            pass

    return chunks.where("source is not null").groupBy("source").transformWithStateInPandas(Taken(), schema, "append", "none")
