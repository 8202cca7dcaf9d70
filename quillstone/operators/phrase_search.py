"""Which phrases stand, word for word, in which documents.

An inverted search: every phrase waits at its rarest word (its anchor), by the
number of documents that hold it.  A document's words are looked up among the
anchors; only where one is met is the phrase around it compared, by the names
of all its words in order.  Phrases are dealt into shards of bounded size, and
the documents are read once for each shard, so no task holds more of the
phrases than a shard and no text is exchanged.  A phrase with a word that no
document has waits nowhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.grams import _ODD, mixed, word_names
from quillstone.plans.store import small_batches, written

U64 = np.uint64
#: Words of all phrases of a shard, at most (a longer phrase is a shard of its own); 16 bytes each are sent to every task.
SHARD_WORDS = 500_000


def _named(words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """128-bit names of the runs of ``size`` words at the places."""
    out = np.zeros((len(start), 2), U64)
    for j in range(size):
        for half in (0, 1):
            out[:, half] = mixed(out[:, half] * _ODD[half] + words[start + j, half])
    return out


def _key(names: np.ndarray) -> np.ndarray:
    """Names as one sortable value each."""
    return np.ascontiguousarray(names).view("V16").ravel()


class _Shard:
    """Phrases ready for search: their vocabulary, then, once frequencies are known, their anchors."""

    def __init__(self, phrases: list[tuple[int, list[str]]]):
        lists = pa.array([w for _, w in phrases], pa.list_(pa.string()))
        self.number = np.array([i for i, _ in phrases], np.int64)
        self.words = word_names(lists.values) if len(phrases) else np.zeros((0, 2), U64)
        self.at = np.asarray(lists.offsets).astype(np.int64)
        self.known, self.code = np.unique(_key(self.words), return_inverse=True)

    def met(self, names: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, or -1."""
        if not len(self.known):
            return np.full(len(names), -1)
        keys = _key(names)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, at, -1)

    def anchored(self, held: np.ndarray) -> None:
        """Every phrase goes to its word that the fewest documents hold (the first of equals), in order of anchors."""
        size = np.diff(self.at)
        place = np.zeros(len(size), np.int64)
        for i, (a, b) in enumerate(zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)):
            place[i] = np.argmin(held[self.code[a:b]])
        anchor = self.code[self.at[:-1] + place]
        alive = held[anchor] > 0
        names = np.zeros((len(size), 2), U64)
        for n in np.unique(size[alive]):
            rows = np.flatnonzero(alive & (size == n))
            names[rows] = _named(self.words, self.at[rows], int(n))
        order = np.flatnonzero(alive)[np.argsort(anchor[alive], kind="stable")]
        self.size, self.place, self.name, self.number = size[order], place[order], names[order], self.number[order]
        self.first = np.searchsorted(anchor[order], np.arange(len(self.known) + 1))
        self.words = self.code = self.at = None  # not needed by the search

    def found(self, names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of phrases that stand in them; each pair once."""
        code = self.met(names)
        at = np.flatnonzero(code >= 0)
        waiting = self.first[code[at] + 1] - self.first[code[at]]
        at, low = np.repeat(at, waiting), np.repeat(self.first[code[at]], waiting)
        phrase = low + np.arange(len(low)) - np.repeat(np.cumsum(waiting) - waiting, waiting)
        start = at - self.place[phrase]
        end = start + self.size[phrase]
        fits = (start >= 0) & (end <= len(row))
        start, end, phrase = start[fits], end[fits], phrase[fits]
        whole = row[start] == row[end - 1]
        start, phrase = start[whole], phrase[whole]
        hit = np.zeros(len(start), bool)
        for n in np.unique(self.size[phrase]):
            rows = np.flatnonzero(self.size[phrase] == n)
            hit[rows] = (_named(names, start[rows], int(n)) == self.name[phrase[rows]]).all(axis=1)
        pairs = np.unique(np.stack([row[start[hit]], phrase[hit]]), axis=1)
        return pairs[0], self.number[pairs[1]]


def _words_of(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of a batch's lists, and the row that each is in."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return word_names(lists.values.slice(offsets[0], offsets[-1] - offsets[0])), np.repeat(np.arange(len(lists)), np.diff(offsets))


def _frequencies(texts: DataFrame, shared) -> np.ndarray:
    """How many documents hold each word of a shard's vocabulary."""

    def kernel(batches):
        total = np.zeros(len(shared.value.known), np.int64)
        for batch in batches:
            names, row = _words_of(batch, 1)
            code = shared.value.met(names)
            pairs = np.unique(np.stack([row, code])[:, code >= 0], axis=1)
            total += np.bincount(pairs[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    held = np.zeros(len(shared.value.known), np.int64)
    for r in texts.mapInArrow(kernel, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():  # a shard's vocabulary at most
        held[r.code] = r.n
    return held


def contained_phrases(docs: DataFrame, phrases: DataFrame, words: Column, phrase_words: Column, id_col: str = "doc_id", phrase_id: str = "item_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(phrase_id, id) of every phrase that stands in a document on word boundaries, whole; each pair once.

    ``words`` and ``phrase_words`` are arrays of words of the two tables.  A
    phrase without words stands nowhere, a null counts as one; phrases of
    several ids are searched once and reported for each; rows of one document id
    count together; rows without id are left out on both sides; a document or
    phrase of any length is compared whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    listed = written(phrases.select(F.col(phrase_id).alias("item"), F.filter(phrase_words, lambda w: w.isNotNull()).alias("w")).where(F.col("item").isNotNull() & (F.size("w") > 0)), "phrases")
    distinct = listed.select("w").distinct().select("w", F.size("w").cast("bigint").alias("n"))
    # phrases are numbered by ranges; a shard is a run of numbers
    ordered = written(distinct.withColumn("number", F.monotonically_increasing_id()), "numbered")
    total = ordered.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(F.filter(words, lambda w: w.isNotNull()), F.array().cast("array<string>")).alias("w"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for k in range(shards):
        mine = ordered.where(F.pmod(F.xxhash64("w"), F.lit(shards)) == k) if shards > 1 else ordered
        shard = _Shard([(r.number, r.w) for r in mine.toLocalIterator()])  # a shard at most
        shared = spark.sparkContext.broadcast(shard)
        shard.anchored(_frequencies(texts, shared))
        shared.unpersist()
        ready = spark.sparkContext.broadcast(shard)

        def kernel(batches, ready=ready):
            for batch in batches:
                names, row = _words_of(batch, 1)
                rows, numbers = ready.value.found(names, row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(numbers)], names=["doc", "number"])

        found = texts.mapInArrow(kernel, f"doc {kind}, number bigint")
        out = found if out is None else out.unionByName(found)
    # both sides of the joins are plain exchanges, so that a phrase that many documents hold can be split
    found = written(out, "found").join(ordered.select("number", "w"), "number").join(listed, "w")
    return found.select(F.col("item").alias(phrase_id), F.col("doc").alias(id_col)).distinct()
