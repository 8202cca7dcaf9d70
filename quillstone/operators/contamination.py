"""Overlap of word grams between documents and evaluation sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import wording
from quillstone.operators import bloom, grams, overlap
from quillstone.plans.store import small_batches, written

GRAM = 13
#: An evaluation set is broadcast up to so many grams of 16 bytes each; beyond, the join is left to the optimizer.
BROADCAST_GRAMS = 1_000_000


def _words(rows: DataFrame, id_col: str, text_col: str, raw: bool) -> tuple[DataFrame, Callable]:
    """The texts; and what makes a function, in a task, that returns row and name of the words of a column of them."""
    small_batches(rows.sparkSession, 1000)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if raw:
        return rows.select(F.col(id_col), T.raw_words(text).alias("w")), lambda: grams.words_of
    bits = wording.letters(rows.sparkSession)

    def made():
        flags = wording.unpacked(bits)

        def named(texts):
            ends, data = wording.bytes_of(texts)
            row, lo, hi = wording.words(ends, data, flags)
            return row, grams.names_of(data, lo, hi)

        return named

    return rows.select(F.col(id_col), F.lower(text).alias("w")), made


def _parts(batches, raw: bool):
    for batch in batches:
        yield from [batch] if raw else wording.slices(batch, 1)


def _mapped(rows: DataFrame, id_col: str, text_col: str, raw: bool, find: Callable) -> DataFrame:
    """(id, gram): what ``find`` returns of the rows and names of words: row numbers and grams."""
    source, made = _words(rows, id_col, text_col, raw)

    def kernel(batches):
        named = made()
        for batch in _parts(batches, raw):
            row, names = find(*named(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names], names=["id", "gram"])

    kind = rows.schema[id_col].dataType.simpleString()
    return source.mapInArrow(kernel, f"id {kind}, gram binary").withColumnRenamed("id", id_col)


def grams_of(rows: DataFrame, id_col: str, text_col: str = "text", n: int = GRAM, raw: bool = False) -> DataFrame:
    """(id, gram): 16-byte names of the distinct grams of each text; none of texts with fewer words."""
    return _mapped(rows, id_col, text_col, raw, lambda row, words: distinct(row, words, n))


def filter_of(rows: DataFrame, id_col: str, n: int = GRAM, raw: bool = False) -> Broadcast:
    """A Bloom filter, of bounded size, of what stands for the grams of some texts: a few values a text, as in ``overlap``."""
    source, made = _words(rows, id_col, "text", raw)

    def kernel(batches):
        named = made()
        for batch in _parts(batches, raw):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(overlap.left_values(*named(batch.column(1)), n)[1]))], names=["value"])

    return _filter(source.mapInArrow(kernel, "value bigint").distinct())


def _filter(values: DataFrame) -> Broadcast:
    values = written(values, "values")
    return _broadcast(values, values.count())


def _broadcast(values: DataFrame, count: int) -> Broadcast:
    return values.sparkSession.sparkContext.broadcast(bloom.build(values, count))


def _named_at(row: np.ndarray, words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and name of the distinct grams that begin at some places."""
    names = grams.names_at(words, at, n)
    first = overlap.first_places(row[at], names) == 1
    return row[at[first]], names[first]


def _all_at(row: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])


def distinct(row: np.ndarray, words: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, pa.Array]:
    """Row number and name of the distinct grams of each row."""
    of, names = _named_at(row, words, _all_at(row, n), n)
    return of, grams.binary(names)


def held(row: np.ndarray, words: np.ndarray, filter_: bloom.Bloom, n: int = GRAM) -> tuple[np.ndarray, pa.Array]:
    """Row number and name of the distinct grams of each row whose value the filter holds; what it doesn't hold is never named."""
    of, names = _named_at(row, words, overlap.held(row, words, n, filter_), n)
    return of, grams.binary(names)


def met_grams(rows: DataFrame, id_col: str, filter_: Broadcast, n: int = GRAM, raw: bool = False) -> DataFrame:
    """(id, gram): of ``grams_of``, all that the texts of the filter have, and few others."""
    return _mapped(rows, id_col, "text", raw, lambda row, words: held(row, words, filter_.value, n))


def gram_texts(rows: DataFrame, id_col: str, text_col: str = "text", n: int = GRAM) -> DataFrame:
    """(id, gram): the distinct grams of each text, spelt out."""
    words = T.normalized_words(F.coalesce(F.col(text_col), F.lit("")))
    sets = rows.select(F.col(id_col), words.alias("w")).select(id_col, F.array_distinct(T.ngrams(F.col("w"), n)).alias("g"))
    # the outer form: a plain explode would have the array tested, and so made, a second time
    return sets.select(id_col, F.explode_outer("g").alias("gram")).where("gram is not null")


def sized(side: DataFrame, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """The same rows, with a broadcast hint if they are few: their number is taken first."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def benchmark_hits(docs: DataFrame, items: DataFrame, owners: str = "first", n: int = GRAM, raw: bool = False) -> DataFrame:
    """(doc_id, item_id, matched): grams that a document shares with an item.

    owners: ``first`` credits a gram that several items hold to the least of
    them only; ``all`` credits each.
    """
    found = met_grams(docs, "doc_id", filter_of(items, "item_id", n, raw), n, raw)
    return found.join(sized(owned(items, owners, n, raw)), "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("matched"))


def owned(items: DataFrame, owners: str = "first", n: int = GRAM, raw: bool = False) -> DataFrame:
    """(gram, item_id) of an evaluation set."""
    index = grams_of(items, "item_id", n=n, raw=raw)
    return index.groupBy("gram").agg(F.min("item_id").alias("item_id")) if owners == "first" else index


def strongest(hits: DataFrame, items: DataFrame, n: int = GRAM) -> DataFrame:
    """Each item's document of the greatest share of its grams, the least id of equals."""
    totals = grams_of(items, "item_id", n=n).groupBy("item_id").agg(F.count("*").alias("item_grams"))
    best = hits.groupBy("item_id").agg(F.max(F.struct("matched", (-F.col("doc_id")).alias("d"))).alias("x"))
    return best.join(totals, "item_id").select("item_id", (-F.col("x.d")).alias("doc_id"), F.col("x.matched").alias("matched"), "item_grams")


def validation(docs: DataFrame, val_docs: int) -> DataFrame:
    """(doc_id, text) of the validation documents, written.

    They are dealt out: in files by id they stand together, and few tasks would have them all.
    """
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // 5)
    return written(docs.where(F.col("doc_id") < val_docs).select("doc_id", "text").repartition(parts), "validation")


def validation_leak(docs: DataFrame, val_docs: int, n: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Leak of each validation document, and shared grams of each training document.

    The first ``val_docs`` ids are validation.  A validation document's leak is the
    share of its distinct grams that some training document holds, 0 without grams.
    """
    val, train = validation(docs, val_docs), docs.where(F.col("doc_id") >= val_docs)
    return leaks(docs, val_docs, val, written(met_grams(train, "doc_id", filter_of(val, "doc_id", n), n), "training_grams"), n)


def leaks(docs: DataFrame, val_docs: int, val: DataFrame, train: DataFrame, n: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``validation_leak`` from the validation texts and a written table of training grams, of which those that no validation document has may be left out."""
    counts, met = _met(val, train, n)
    leak = counts.join(met.groupBy("doc_id").agg(F.count("*").alias("seen")), "doc_id", "left")
    every = docs.where(F.col("doc_id") < val_docs).select("doc_id").join(leak, "doc_id", "left")
    every = every.select("doc_id", F.coalesce("grams", F.lit(0)).alias("grams"), F.coalesce("seen", F.lit(0)).alias("seen"))
    overlap = shared(train, met).groupBy("doc_id").agg(F.count("*").alias("shared"))
    overlap = docs.where(F.col("doc_id") >= val_docs).select("doc_id").join(overlap, "doc_id", "left").select("doc_id", F.coalesce("shared", F.lit(0)).alias("shared"))
    return every, overlap


def shared(train: DataFrame, met: DataFrame) -> DataFrame:
    """(doc_id, gram) of training that some validation document has."""
    return train.join(sized(written(met.select("gram").distinct(), "wanted")), "gram").select("doc_id", "gram")


def _met(val: DataFrame, train: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, grams): the number of distinct grams of each validation document; and (doc_id, gram) of those that training has.

    A Bloom filter of the training grams tells which grams of validation become rows; an exact join decides.
    """
    known = written(train.select("gram").distinct(), "known")

    def heads(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(grams.names_in(batch.column(0))[:, 0].view(np.int64))], names=["value"])

    filter_ = _broadcast(known.mapInArrow(heads, "value bigint"), known.count())
    source, made = _words(val, "doc_id", "text", False)

    def kernel(batches):
        named = made()
        for batch in _parts(batches, False):
            row, words = named(batch.column(1))
            of, names = _named_at(row, words, _all_at(row, n), n)
            size = np.bincount(of, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.nulls(batch.num_rows, pa.binary())], names=["doc_id", "grams", "gram"])
            some = filter_.value.holds(names[:, 0]) if len(names) else np.zeros(0, bool)
            of, names = of[some], names[some]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.nulls(len(of), pa.int64()), grams.binary(names)], names=["doc_id", "grams", "gram"])

    kind = val.schema["doc_id"].dataType.simpleString()
    both = written(source.mapInArrow(kernel, f"doc_id {kind}, grams bigint, gram binary"), "validation_grams")
    counts = both.where("gram is null").groupBy("doc_id").agg(F.sum("grams").alias("grams"))
    return counts, written(both.where("gram is not null").select("doc_id", "gram").join(sized(known), "gram"), "met")
