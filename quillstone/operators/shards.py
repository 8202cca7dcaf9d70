"""Packing documents into token shards, with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.store import written


def positions(sized: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", parts: int | None = None) -> DataFrame:
    """``sized`` with ``first_token``: tokens of all documents of smaller id.

    Prefix sums in two levels, so no task sees the whole table: ranges of ids are
    summed apart, the few range totals are summed in order, and each range is
    then offset by what lies before it.  Unless their number is given, there is
    a range for every two million rows, and at least 16.
    """
    parts = parts or max(16, sized.select(id_col).count() // 2_000_000)
    # written: the number of a row's range is then fixed
    part = written(sized.repartitionByRange(parts, id_col).withColumn("part", F.spark_partition_id()), "ranges")
    totals = part.groupBy("part").agg(F.sum(size_col).alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inner = F.coalesce(F.sum(size_col).over(Window.partitionBy("part").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("inner", inner).join(F.broadcast(before), "part").withColumn("first_token", F.col("before") + F.col("inner")).drop("part", "inner", "before")


def shard_of(position, val_tokens: int, shard_tokens: int):
    """Shard 0 is validation; the others are filled one after another."""
    return F.when(position < val_tokens, F.lit(0).cast("bigint")).otherwise(1 + F.floor((position - val_tokens) / shard_tokens).cast("bigint"))


def manifest(sized: DataFrame, val_tokens: int, shard_tokens: int, bytes_col: str = "text_bytes") -> DataFrame:
    """(file, split, shard, tokens, docs, text_bytes) of every shard.

    Documents cross shard ends; a document's count and bytes belong to the shard of
    its first token.  Only documents are handled, never single tokens: a document's
    tokens are dealt to the shards that its span meets.
    """
    placed = positions(sized).withColumn("end", F.col("first_token") + F.col("n_tokens"))
    home = shard_of(F.col("first_token"), val_tokens, shard_tokens)
    last = shard_of(F.col("end") - 1, val_tokens, shard_tokens)
    spread = placed.where("n_tokens > 0").withColumn("home", home).withColumn("shard", F.explode(F.sequence(home, last)))
    low = F.when(F.col("shard") == 0, F.lit(0)).otherwise(val_tokens + (F.col("shard") - 1) * shard_tokens)
    high = F.when(F.col("shard") == 0, F.lit(val_tokens)).otherwise(val_tokens + F.col("shard") * shard_tokens)
    inside = F.least(F.col("end"), high) - F.greatest(F.col("first_token"), low)
    owned = F.col("shard") == F.col("home")
    out = spread.groupBy("shard").agg(F.sum(inside).cast("bigint").alias("tokens"), F.count_if(owned).alias("docs"), F.sum(F.when(owned, F.col(bytes_col)).otherwise(0)).cast("bigint").alias("text_bytes"))
    split = F.when(F.col("shard") == 0, "val").otherwise("train")
    return out.select(F.concat(split, F.lit("_"), F.lpad(F.col("shard").cast("string"), 4, "0"), F.lit(".parquet")).alias("file"), split.alias("split"), "shard", "tokens", "docs", "text_bytes")


def budgeted(sized: DataFrame, max_tokens: int, batch_docs: int = 1024) -> DataFrame:
    """Documents up to a token budget that is tested after whole batches only."""
    batches = sized.withColumn("batch", F.floor(F.col("doc_id") / batch_docs))
    totals = batches.groupBy("batch").agg(F.sum("n_tokens").alias("n"))
    open_ = positions(totals, "batch", "n").where(F.col("first_token") < max_tokens).select("batch")
    return batches.join(open_, "batch", "left_semi").drop("batch")


def fixed_windows(docs: DataFrame, seq_len: int, shard_tokens: int, num_tokens: int | None = None, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(win, docs, x, y): the same consecutive windows of the first shard at every call.

    A window reads ``seq_len`` tokens and one more: ``x`` are all but the last,
    ``y`` all but the first, so the token at a window's end is also the next
    one's first.  There are as many windows as fit in ``num_tokens`` (in all of
    the shard, if None) and still have their look-ahead inside the shard.
    Documents lie end to end by id; each is cut into the windows that it meets
    where it is, and a window gathers ``seq_len`` + 1 tokens.  Ids are taken to
    be unique; documents with null or no tokens take no place, of any length
    are taken whole; an empty table has no windows.
    """
    sized = docs.where(F.size(tokens_col) > 0).select(id_col, F.size(tokens_col).cast("bigint").alias("n_tokens"))
    placed = written(positions(sized, id_col).where(F.col("first_token") < shard_tokens), "placed")
    held = placed.agg(F.max(F.col("first_token") + F.col("n_tokens")).alias("n")).first().n or 0
    length = min(int(held), shard_tokens)
    wanted = length if num_tokens is None else num_tokens
    count = min(wanted // seq_len, max(length - 1, 0) // seq_len)
    start, end = F.col("first_token").cast("bigint"), (F.col("first_token") + F.col("n_tokens")).cast("bigint")
    spans = placed.select(id_col, start.alias("p"), F.least(end, F.lit(count * seq_len + 1 if count else 0)).alias("e")).where("p < e")
    cut = spans.withColumn("win", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.expr(f"(p - 1) div {seq_len}")), F.least(F.expr(f"(e - 1) div {seq_len}"), F.lit(max(count - 1, 0))))))
    cut = cut.join(docs.select(id_col, tokens_col), id_col)
    low, high = F.greatest("p", F.col("win") * seq_len), F.least("e", F.col("win") * seq_len + seq_len + 1)
    pieces = cut.select("win", low.alias("at"), F.slice(tokens_col, (low - F.col("p") + 1).cast("int"), (high - low).cast("int")).alias("piece")).where(F.size("piece") > 0)
    whole = pieces.groupBy("win").agg(F.count("*").alias("docs"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"])).alias("w"))
    return whole.select("win", "docs", F.slice("w", 1, seq_len).alias("x"), F.slice("w", 2, seq_len).alias("y"))
