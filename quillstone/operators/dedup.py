"""Exact and near duplicates: word shingles, MinHash signatures, banded hashing, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import md5
from quillstone.functions import text as T
from quillstone.operators import grams
from quillstone.operators.components import connected_components
from quillstone.plans.store import small_batches, written

SHINGLE, PERMUTATIONS, BANDS, SIMILAR = 5, 128, 16, 0.8


def permutation(i: int) -> tuple[int, int]:
    """Factor, which is odd, and offset of the i-th hash function, by rule."""
    digits = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:16], 16)
    return digits(f"a{i}") | 1, digits(f"b{i}")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, norm, shingles): normalised text and the distinct 32-bit hashes of its word shingles, ascending.

    A hash is the first 32 bits of the MD5 digest, which any engine has.
    """
    small_batches(docs.sparkSession, 1000)

    def kernel(batches):
        for batch in batches:
            norm, sets = [], []
            for words in batch.column(1).to_pylist():
                norm.append(" ".join(words))
                raw = [w.encode() for w in words]
                grams = {b" ".join(raw[i : i + SHINGLE]) for i in range(len(raw) - SHINGLE + 1)}
                sets.append(sorted({int.from_bytes(hashlib.md5(g).digest()[:4], "big") for g in grams}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "norm", "shingles"])

    words = T.normalized_words(F.coalesce(F.col(text_col), F.lit("")))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), words.alias("w")).mapInArrow(kernel, f"doc_id {kind}, norm string, shingles array<bigint>")


def signatures(sets: DataFrame) -> DataFrame:
    """(doc_id, norm, sig): least value of each hash function over the shingles; null without any.

    The functions are multiply-add-shift modulo 2**64, of which the upper 32
    bits count.  One pass in Arrow batches: shingles x functions, in blocks of
    bounded size.
    """
    small_batches(sets.sparkSession, 1000)
    a, b = (np.array(x, np.uint64) for x in zip(*[permutation(i) for i in range(PERMUTATIONS)], strict=True))
    kind = sets.schema["doc_id"].dataType.simpleString()

    def kernel(batches):
        for batch in batches:
            lists = batch.column(2)
            out = []
            for i in range(len(lists)):
                x = np.asarray(lists[i].values).astype(np.uint64)
                best = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
                for lo in range(0, len(x), 1024):
                    part = x[lo : lo + 1024, None] * a
                    part += b
                    best = np.minimum(best, part.min(axis=0))
                out.append((best >> np.uint64(32)).astype(np.int64) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "norm", "sig"])

    return sets.mapInArrow(kernel, f"doc_id {kind}, norm string, sig array<bigint>")


def signs(texts: pa.StringArray) -> tuple[pa.Array, pa.Array]:
    """``norm`` and ``sig`` of texts whose words are joined by one space."""
    a, b = (np.array(x, np.uint64) for x in zip(*[permutation(i) for i in range(PERMUTATIONS)], strict=True))
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
    some = ends[1:] > ends[:-1]
    blank = ends[0] + np.flatnonzero(data[ends[0] :] == 32)
    lo, hi = np.sort(np.concatenate([ends[:-1][some], blank + 1])), np.sort(np.concatenate([ends[1:][some], blank]))
    row = np.searchsorted(ends, lo, "right") - 1
    whole = np.flatnonzero(row[: max(0, len(row) - SHINGLE + 1)] == row[SHINGLE - 1 :])
    heads = md5.heads(data, lo[whole], hi[whole + SHINGLE - 1])
    cut = np.searchsorted(row[whole], np.arange(len(texts) + 1))
    norm, out = [], []
    for i in range(len(texts)):
        x = heads[cut[i] : cut[i + 1]]
        # repeats change no minimum; sorting them out is worth while in long texts, which may repeat themselves much
        x = (np.unique(x) if len(x) > 2048 else x).astype(np.uint64)
        if not len(x):
            norm.append(texts[i].as_py())
            out.append(None)
            continue
        best = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(x), 256):
            part = x[k : k + 256, None] * a
            part += b
            np.minimum(best, part.min(axis=0), out=best)
        norm.append(None)
        out.append((best >> np.uint64(32)).astype(np.int64))
    return pa.array(norm, pa.string()), pa.array(out, pa.list_(pa.int64()))


def band_keys(sigs: pa.ListArray, bands: int = BANDS) -> pa.Array:
    """What stands for each band of each signature; null for a null one."""
    some = np.flatnonzero(sigs.is_valid().to_numpy(zero_copy_only=False))
    parts = np.asarray(sigs.flatten()).view(np.uint64).reshape(len(some), bands, PERMUTATIONS // bands)
    keys = np.zeros((len(some), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(parts.shape[2]):
        keys = grams.mixed(keys * grams.U64(grams.BASE) + parts[:, :, j])
    out: list = [None] * len(sigs)
    for i, row in zip(some, keys.view(np.int64), strict=True):
        out[i] = row
    return pa.array(out, pa.list_(pa.int64()))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, norm, sig, keys): ``signatures`` of the ``shingle_sets``, and their ``band_keys``, in one pass over each text.

    A text goes to the kernel as one string of its words, of which shingles are
    cut; neither words nor hashes become rows or lists.  ``norm`` is kept only
    where there is no signature, as nothing else compares it.
    """
    small_batches(docs.sparkSession, 1000)
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches):
        for batch in batches:
            norm, sig = signs(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), norm, sig, band_keys(sig)], names=["doc_id", "norm", "sig", "keys"])

    words = F.array_join(T.normalized_words(F.coalesce(F.col(text_col), F.lit(""))), " ")
    return docs.select(F.col(id_col).alias("doc_id"), words.alias("w")).mapInArrow(kernel, f"doc_id {kind}, norm string, sig array<bigint>, keys array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.size(a)


def candidates(sigs: DataFrame, bands: int = BANDS, fresh: bool = True) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's least id; a star, so as many rows as members.

    ``fresh`` signatures are written first; those of a written table are read as they are.
    """
    rows = PERMUTATIONS // bands
    # written: they are read twice, and making them is most of the work
    sigs = written(sigs.select("doc_id", "sig"), "signatures") if fresh else sigs
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("sig")[i * rows + j] for j in range(rows)]) for i in range(bands)])
    return met_by(sigs.where("sig is not null").select("doc_id", F.explode(keys).alias("key")))


def met_by(entries: DataFrame) -> DataFrame:
    """``candidates`` from the rows (doc_id, key) of a written table."""
    least = entries.groupBy("key").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    # written, so that the join is of two plain exchanges and a hot bucket can be split
    return entries.join(written(least, "buckets"), "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, cluster): the least id of each cluster of documents whose estimated similarity is high.

    Texts with fewer words than a shingle cluster only if they are equal.
    """
    return clusters_of(written(signed(docs, id_col, text_col), "signatures"), similar)


def clusters_of(sigs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``near_duplicates`` of a written table of ``signed`` texts."""
    pairs = met_by(sigs.where("keys is not null").select("doc_id", F.explode("keys").alias("key")))
    left, right = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(estimate(F.col("sa"), F.col("sb")) >= similar).select("a", "b")
    short = sigs.where("sig is null")
    first = written(short.groupBy("norm").agg(F.min("doc_id").alias("b")), "short")
    equal = short.join(first, "norm").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    roots = connected_components(near.union(equal))
    return sigs.select("doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("cluster"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, group_size): least id and number of the documents of one normalised text."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.array_join(T.normalized_words(F.coalesce(F.col(text_col), F.lit(""))), " ").cast("binary")).alias("digest"))
    groups = written(d.groupBy("digest").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")), "groups")
    return d.join(groups, "digest").select("doc_id", "group_id", "group_size")
