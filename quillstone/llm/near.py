"""Near-duplicates by exact Jaccard similarity of word shingles, without comparing all pairs of a group.

Texts meet through bands of minima of their hashed shingles.  Of those that
share a band, the most central one is the pivot: each other set is written as
its difference from the pivot's, that is the shingles it lacks and those it
has besides.  Sets similar to the pivot are linked to it.  Two others that are
similar must share shingles of their differences, as many as follows from
their sizes alone, so the rest of the pairs is found by joining differences
under a prefix filter, and compared by them.

With r = similar / (1 + similar), c the pivot's set, x shingles lacking and e
besides, w = (1 - r) x + r e and t = (1 - 2r) |c|, a set is similar to the pivot
just if w <= t, and two sets are similar just if their differences share at
least w + w' - t shingles.  Two linked sets are in one group already; for all
other pairs that number is positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.llm.simhash import shingle_hashes
from quillstone.operators.components import connected_components
from quillstone.plans.store import batches_of, small_batches, written

U64 = np.uint64
WIDTH, SIMILAR = 5, 0.8
#: Bands and minima of each: a pair of similarity 0.8 shares no band with chance (1 - 0.8**8)**64, about 8e-6.
BANDS, ROWS = 64, 8
#: Sets of two texts in a row.
PAIRS = 128
_EPS = 1e-9

_rng = np.random.default_rng(23)
_FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(block: B.Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, ascending, and where each text's begin (n + 1 entries)."""
    h, first = shingle_hashes(block, width)
    text = np.repeat(np.arange(block.n), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    cut = np.zeros(block.n + 1, np.int64)
    np.cumsum(np.bincount(text[new], minlength=block.n), out=cut[1:])
    return h[new], cut


def set_names(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One word per set, from all its members; 0 for the empty set."""
    out = np.zeros(len(cut) - 1, U64)
    live = np.flatnonzero(np.diff(cut))
    if len(live):
        out[live] = B.mix64(np.add.reduceat(B.mix64(h ^ U64(0x9E3779B97F4A7C15)), cut[live]))
    return out


def band_keys(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sets that are not empty x ``BANDS``: a hash of each band's minima."""
    at = cut[:-1][np.diff(cut) > 0]
    keys = np.empty((len(at), BANDS), U64)
    if not len(at):
        return keys
    high = (h >> U64(32)).astype(np.uint32)
    for band in range(BANDS):
        key = np.full(len(at), band + 1, U64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = B.mix64(key ^ np.minimum.reduceat(high * _FACTORS[i] + _OFFSETS[i], at).astype(U64))
        keys[:, band] = key
    return keys


def _named(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, c, keys): the name of each text's shingle set, and its band keys."""

    def kernel(batches):
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                h, cut = shingle_sets(block, width)
                first = np.concatenate([[0], np.cumsum((np.diff(cut) > 0) * BANDS)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(first), pa.array(band_keys(h, cut).view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(set_names(h, cut).view(np.int64)), keys], names=["id", "c", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(kernel, f"id {kind}, c bigint, keys array<bigint>")


def _members(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(c, items): each text's shingle set as ascending words."""

    def kernel(batches):
        for batch in batches:
            for block in B.blocks(batch.column(0)):
                h, cut = shingle_sets(block, width)
                items = [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_names(h, cut).view(np.int64)), pa.array(items, pa.binary())], names=["c", "items"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(kernel, "c bigint, items binary")


def _words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _differences(similar: float):
    """(p, a, items of p, items of a) -> how the second set differs from the first, and whether they are similar."""

    def kernel(batches):
        for batch in batches:
            rows = []
            for c, u in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                c, u = _words(c), _words(u)
                more, less = np.setdiff1d(u, c, assume_unique=True), np.setdiff1d(c, u, assume_unique=True)
                both = len(c) - len(less)
                rows.append((len(c), both / (len(c) + len(more)) >= similar, less.tobytes(), more.tobytes()))
            n, linked, less, more = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(less, pa.binary()), pa.array(more, pa.binary())],
                names=["p", "a", "n", "linked", "less", "more"],
            )

    return kernel


def _difference_keys(similar: float):
    """(p, a, tie, n, linked, less, more) -> the shingles by which a set can be found from others of the same pivot.

    Of a difference's shingles that must be shared, one lies among the first
    ones, as many as are left if the others were all shared; ``left`` is how
    many there are from it on.  ``besides`` says which part of the difference
    it is of; pairs are looked for among the shingles lacking only if they need
    not share any besides.
    """
    r = similar / (1 + similar)

    def kernel(batches):
        for batch in batches:
            index, word, left, besides, lacks, has = [], [], [], [], [], []
            for i, (n, linked, less, more) in enumerate(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True)):
                less, more = _words(less), _words(more)
                x, e, t = len(less), len(more), (1 - 2 * r) * n
                w = (1 - r) * x + r * e
                # the other of a pair has w' > t if this one is linked, and w' >= 0 if not
                least = w if linked else w - t
                parts = [(True, more, least - x)]
                if (w - x < t) if not linked else (e < x):
                    parts.append((False, less, least))
                for besides_, words, shared in parts:
                    k = len(words) - max(1, int(np.ceil(shared - _EPS))) + 1
                    if k > 0:
                        index.append(np.full(k, i))
                        word.append(words[:k])
                        left.append(len(words) - np.arange(k))
                        besides.append(np.full(k, besides_))
                lacks.append(x)
                has.append(e)
            at = np.concatenate(index) if index else np.zeros(0, np.int64)
            take = lambda values: pa.array(np.asarray(values, np.int64)[at])  # noqa: B023, E731
            part = lambda k: batch.column(k).take(pa.array(at))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [part(0), part(1), part(2), part(3), part(4), take(lacks), take(has), pa.array(np.concatenate(word).astype(U64).view(np.int64) if word else [], pa.int64()), pa.array(np.concatenate(left) if left else [], pa.int64()), pa.array(np.concatenate(besides) if besides else [], pa.bool_())],
                names=["p", "a", "tie", "n", "linked", "x", "e", "word", "left", "besides"],
            )

    return kernel


def _similar_by_differences(similar: float):
    """(a, b, n, less and more of a, less and more of b) -> the pairs that are similar."""

    def kernel(batches):
        for batch in batches:
            near = []
            for n, *parts in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
                xa, ea, xb, eb = map(_words, parts)
                both = n - len(xa) - len(xb) + len(np.intersect1d(xa, xb, assume_unique=True)) + len(np.intersect1d(ea, eb, assume_unique=True))
                near.append(both / (2 * n - len(xa) - len(xb) + len(ea) + len(eb) - both) >= similar)
            held = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(held), batch.column(1).filter(held)], names=["a", "b"])

    return kernel


def _pairs_to_compare(rows: DataFrame, similar: float) -> DataFrame:
    """(p, a, b): pairs of one pivot, not in one group yet, whose differences may share enough."""
    r = similar / (1 + similar)
    keys = written(rows.select("p", "a", "tie", "n", "linked", "less", "more").mapInArrow(_difference_keys(similar), "p bigint, a bigint, tie bigint, n bigint, linked boolean, x bigint, e bigint, word bigint, left bigint, besides boolean"), "differences")
    one = keys.select("p", "word", "besides", "n", "a", "tie", "linked", "x", "e", "left")
    two = keys.select(F.col("p").alias("p2"), F.col("word").alias("word2"), F.col("besides").alias("besides2"), F.col("a").alias("b"), F.col("tie").alias("tie2"), F.col("linked").alias("linked2"), F.col("x").alias("x2"), F.col("e").alias("e2"), F.col("left").alias("left2"))
    need = (1 - r) * (F.col("x") + F.col("x2")) + r * (F.col("e") + F.col("e2")) - (1 - 2 * r) * F.col("n")
    rest = F.least("left", "left2")
    most = F.when(F.col("besides"), F.least("x", "x2") + rest).otherwise(rest)
    on = (F.col("p") == F.col("p2")) & (F.col("word") == F.col("word2")) & (F.col("besides") == F.col("besides2")) & (F.col("a") > F.col("b")) & (F.col("tie") != F.col("tie2")) & ~(F.col("linked") & F.col("linked2")) & (need <= most + _EPS)
    return one.join(two, on).select("p", "a", "b").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: float = SIMILAR, groups: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` that has an id: its id and ``component_id``.

    ``component_id`` is the least id reachable over pairs whose sets of
    ``width``-word shingles have a Jaccard similarity of ``similar`` or more,
    its own included.  A text with fewer words has one shingle of all of them;
    texts without words are linked.  Sets are named by 64-bit hashes, and rows
    of one set count once.  All pairs that share a band are decided exactly.  A
    text of any length gives one set; an empty table gives no rows; other columns
    are ignored.

    ``groups`` (id, component_id) are near-duplicates found elsewhere: the sets of
    a group meet as those of a band do, and are decided by the same check.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull())
    prints = written(_named(rows, id_col, text_col, width), "shingle_names")
    classes = written(prints.groupBy("c").agg(F.min("id").alias("least_id"), F.first("keys").alias("keys")), "shingle_classes")
    entries = classes.select("c", F.explode("keys").alias("key"))
    if groups is not None:
        # texts without words have one set, named 0, anyway
        keyed = classes.where("c <> 0").select("c", F.col("least_id").alias(id_col))
        found = groups.select(id_col, F.xxhash64(F.lit(BANDS), "component_id").alias("key")).distinct()
        entries = entries.union(keyed.join(found, id_col).select("c", "key").distinct())
    met = written(entries.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "bands")
    shared = written(entries.join(met, "key"), "shared_bands")
    # the most central set of a band: that which meets most others over all its bands
    central = shared.groupBy("c").agg(F.sum("k").alias("weight"))
    pivots = written(shared.join(central, "c").groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("c").alias("h"), "c")).alias("m")).select("key", F.col("m.c").alias("p")), "pivots")
    stars = written(shared.join(pivots, "key").where("c <> p").select("p", F.col("c").alias("a")).distinct(), "stars")

    asked = stars.select(F.col("p").alias("c")).union(stars.select(F.col("a").alias("c"))).distinct()
    ids = classes.join(asked, "c", "left_semi").select(F.col("least_id").alias(id_col)).distinct()
    sets = written(_members(rows.join(ids, id_col, "left_semi"), text_col, width).join(asked, "c", "left_semi").dropDuplicates(["c"]), "sets")
    with batches_of(spark, PAIRS):
        of = stars.join(sets.select(F.col("c").alias("p"), F.col("items").alias("u")), "p").join(sets.select(F.col("c").alias("a"), F.col("items").alias("v")), "a")
        differ = written(of.select("p", "a", "u", "v").mapInArrow(_differences(similar), "p bigint, a bigint, n bigint, linked boolean, less binary, more binary"), "differ")
        ties = differ.where("linked").select("a", F.col("p").alias("b"))
        tied = connected_components(ties).select(F.col("node").alias("a"), F.col("root").alias("tie"))
        open_ = written(differ.groupBy("p").agg(F.count("*").alias("k"), F.count_if(~F.col("linked")).alias("apart")).where("k > 1 and apart > 0").select("p"), "open")
        left = written(differ.join(open_, "p", "left_semi").join(tied, "a", "left").withColumn("tie", F.coalesce("tie", "a")), "left")
        pairs = _pairs_to_compare(left, similar)
        one = left.select("p", "a", "n", F.col("less").alias("xa"), F.col("more").alias("ea"))
        two = left.select("p", F.col("a").alias("b"), F.col("less").alias("xb"), F.col("more").alias("eb"))
        found = pairs.join(one, ["p", "a"]).join(two, ["p", "b"]).select("a", "b", "n", "xa", "ea", "xb", "eb")
        found = found.mapInArrow(_similar_by_differences(similar), "a bigint, b bigint")
        roots = connected_components(ties.union(found)).withColumnRenamed("node", "c")
    labelled = classes.select("c", "least_id").join(roots, "c", "left").select("c", "least_id", F.coalesce("root", "c").alias("root"))
    # what hot keys are joined with is written first: a join of two plain exchanges can split them
    least = written(labelled.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = written(labelled.join(least, "root").select("c", "component_id"), "named")
    return prints.select("id", "c").join(named, "c").select(F.col("id").alias(id_col), "component_id")
