"""The corpus audit: quality, duplicates, leaks and what to keep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import wording
from quillstone.operators import contamination, dedup, grams, quality
from quillstone.plans.store import small_batches, written

OVERLAP_LIMIT = 50
#: How much of a text a report shows.
SNIPPET = 300


def measured(docs: DataFrame, val_docs: int, val: DataFrame, items: DataFrame | None = None, rules: bool = False) -> DataFrame:
    """All that an audit takes from the texts, by one pass over them; written.

    One row a document, of null ``kind``: its signature and keys as ``dedup.signed`` has them and, for ``rules``,
    the counts of ``quality.counted``.  And a row for each 13-word gram that may be shared: of
    ``kind`` 0 with ``val``, the validation texts, from training documents, and 1 with the ``items``.
    """
    small_batches(docs.sparkSession, 1000)
    filters = [contamination.filter_of(val, "doc_id"), *([contamination.filter_of(items, "item_id")] if items is not None else [])]
    counts = [*quality.COUNTED, "grams", "repeated"] if rules else []
    names = ["doc_id", *counts, "norm", "sig", "keys", "kind", "gram"]
    types = [pa.int64()] * len(counts) + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.lower(text).alias("low"), *([text.alias("text")] if rules else []))
    letters = wording.letters(docs.sparkSession)

    def kernel(batches):
        flags = wording.unpacked(letters)
        for batch in (part for batch in batches for part in wording.slices(batch, 1)):
            ids, rows = batch.column(0), batch.num_rows
            ends, data = wording.bytes_of(batch.column(1))
            row, lo, hi = wording.words(ends, data, flags)
            named = grams.names_of(data, lo, hi)
            own = []
            if rules:
                total, _, again = grams.occurrences(row, named, rows, quality.GRAM)
                of = wording.counts(batch.column(2)) | {"words": np.bincount(row, minlength=rows), "word_chars": wording.word_chars(data, row, lo, hi, rows)}
                own = [pa.array(x, pa.int64()) for x in (*[of[name] for name in quality.COUNTED], total, again)]
            nothing = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
            norm, sig = dedup.signs(wording.joined(data, row, lo, hi, rows))
            yield pa.RecordBatch.from_arrays([ids, *own, norm, sig, dedup.band_keys(sig), *nothing], names=names)
            train = pc.fill_null(pc.greater_equal(ids, val_docs), False).to_numpy(zero_copy_only=False)
            for kind, filter_ in enumerate(filters):
                at, found = contamination.held(row, named, filter_.value)
                if kind == 0:
                    at, found = at[train[at]], found.filter(pa.array(train[at]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *[pa.nulls(len(at), t) for t in types], pa.array([kind] * len(at), pa.int32()), found], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + "".join(f"{name} bigint, " for name in counts) + "norm string, sig array<bigint>, keys array<bigint>, kind int, gram binary"
    return written(source.mapInArrow(kernel, schema), "measured")


def audit(docs: DataFrame, items: DataFrame, val_docs: int, rules: bool = True) -> DataFrame:
    """One row per document: is_val, flag_bits, near_dup, val_cluster, shared, bench_items, keep, keep_strict.

    ``keep`` is for curation: no validation document, no failed rule, no later
    copy, nothing near validation, fewer than ``OVERLAP_LIMIT`` grams shared with it,
    no benchmark gram.  ``keep_strict`` rebuilds shards: validation stays, and
    training documents go for a single shared gram, but not for quality.  Ids are
    taken to be unique: documents without id go, and rows that share an id meet
    one another.  Without ``rules``, what needs them (words, flag_bits, keep) is left out.
    """
    val = contamination.validation(docs, val_docs)
    m = measured(docs, val_docs, val, items, rules)
    rows = m.where("kind is null")
    flagged = quality.flags(rows).select("doc_id", "words", "flag_bits") if rules else rows.select("doc_id")
    clusters = dedup.clusters_of(rows.select("doc_id", "norm", "sig", "keys"))
    _, overlap = contamination.leaks(docs, val_docs, val, m.where("kind = 0").select("doc_id", "gram"))
    found = m.where("kind = 1").select("doc_id", "gram").join(contamination.sized(contamination.owned(items)), "gram")
    hits = found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("bench_items"))
    d = flagged.join(clusters, "doc_id").join(overlap, "doc_id", "left").join(hits, "doc_id", "left")
    d = d.withColumns(
        {
            "is_val": F.col("doc_id") < val_docs,
            "near_dup": F.col("cluster") != F.col("doc_id"),
            "val_cluster": F.col("cluster") < val_docs,
            "shared": F.coalesce("shared", F.lit(0)),
            "bench_items": F.coalesce("bench_items", F.lit(0)),
        }
    )
    clean = ~F.col("near_dup") & (F.col("bench_items") == 0)
    if rules:
        d = d.withColumn("keep", ~F.col("is_val") & (F.col("flag_bits") == 0) & clean & ~F.col("val_cluster") & (F.col("shared") < OVERLAP_LIMIT))
    return d.withColumn("keep_strict", F.col("is_val") | (clean & (F.col("shared") == 0)))


def _first(rows: DataFrame, measure: str, value: str, k: int) -> DataFrame:
    """The k rows of greatest value, the least id of equals: every task keeps k at most, so nothing is sorted as a whole."""
    top = rows.select("doc_id", F.col(value).cast("double").alias("value")).orderBy(F.desc("value"), "doc_id").limit(k)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("value"), "doc_id"))  # k rows
    return top.select(F.lit(measure).alias("measure"), place.cast("bigint").alias("place"), "doc_id", "value")


def examples(docs: DataFrame, val_docs: int, k: int = 5) -> DataFrame:
    """The worst of each kind, with the beginning of their texts: measure, place, doc_id, value, grams, snippet.

    ``cluster``: roots of the largest groups of near duplicates, by size.
    ``leak``: validation documents by the share of their grams that training holds.
    ``overlap``: training documents by grams shared with validation, at least one.
    ``grams`` is a document's number of distinct grams.  Texts are fetched for
    the chosen alone.  Null texts have a null snippet and no grams; documents
    without id are never chosen; an id with several texts is shown with the
    least of them; an empty table gives no rows.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    val = contamination.validation(docs, val_docs)
    m = measured(docs, val_docs, val)
    sizes = dedup.clusters_of(m.where("kind is null").select("doc_id", "norm", "sig", "keys")).groupBy(F.col("cluster").alias("doc_id")).agg(F.countDistinct("doc_id").alias("size"))
    leak, overlap = contamination.leaks(docs, val_docs, val, m.where("kind = 0").select("doc_id", "gram"))
    shares = leak.withColumn("leak", F.when(F.col("grams") > 0, F.col("seen") / F.col("grams")).otherwise(F.lit(0.0)))
    chosen = _first(sizes, "cluster", "size", k).unionByName(_first(shares, "leak", "leak", k)).unionByName(_first(overlap.where("shared > 0"), "overlap", "shared", k))
    chosen = written(chosen, "chosen")
    shown = written(docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"), "shown")
    counts = contamination.grams_of(shown, "doc_id").groupBy("doc_id").agg(F.countDistinct("gram").alias("grams"))
    snippets = shown.groupBy("doc_id").agg(F.min(F.substring("text", 1, SNIPPET)).alias("snippet"))
    out = chosen.join(snippets, "doc_id").join(counts, "doc_id", "left")
    return out.select("measure", "place", "doc_id", "value", F.coalesce("grams", F.lit(0)).alias("grams"), "snippet")
