"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.operators.components import connected_components
from quillstone.plans.store import small_batches, written

U64 = np.uint64
_ONES = U64(0x0101010101010101)


def bit_majorities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One word per group ``hashes[first[i]:first[i+1]]``: bits set in over half of it.

    Bits are counted eight at a time in the byte lanes of a word, over runs of
    at most 255 hashes, which no lane can overflow.
    """
    n = len(first) - 1
    size = np.diff(first)
    out = np.zeros(n, U64)
    live = np.flatnonzero(size > 0)
    if not len(live):
        return out
    runs = -(-size[live] // 255)
    offset = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    run_at = np.repeat(first[live], runs) + 255 * offset
    run_group = np.cumsum(runs) - runs
    for j in range(8):
        lanes = np.add.reduceat((hashes >> U64(j)) & _ONES, run_at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_group, axis=0)
        major = (2 * counts > size[live][:, None]).astype(np.uint8)
        out[live] |= major.view(U64).reshape(-1) << U64(j)
    return out


def shingle_hashes(block: B.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text of a block, and where each text's begin (n + 1 entries)."""
    words = B.Words(block, B.SPACED, lower=True)
    buf, start, end = B.joined(words)
    count = np.diff(words.first)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = B.ragged(words.first[:-1], shingles)
    span = np.repeat(np.minimum(count, width), shingles)
    h = B.xxh64_spans(buf, start[at], end[at + span - 1]) if len(at) else np.zeros(0, U64)
    first = np.zeros(block.n + 1, np.int64)
    np.cumsum(shingles, out=first[1:])
    return h, first


def fingerprints(block: B.Block, width: int = 3) -> np.ndarray:
    """64-bit SimHash of each text of a block."""
    return bit_majorities(*shingle_hashes(block, width))


HALVES = (0, 1)
RADIUS = 3
#: Fingerprints that share a half with more than this many others are first tied by balls around them.
DENSE = 64


def _half(fp, which: int):
    return F.shiftrightunsigned(fp, 32) if which else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _key(half, which: int):
    """One long for (which half, its value)."""
    return half.bitwiseOR(F.lit(which << 32)) if which else half


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of every text; a text without words, or null, has 0."""
    small_batches(docs.sparkSession)

    def kernel(batches):
        for batch in batches:
            parts = [fingerprints(b, width).view(np.int64) for b in B.blocks(batch.column(1))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(kernel, f"id {kind}, fp bigint")


def _ball_ties(dense: DataFrame) -> DataFrame:
    """Links among fingerprints two bits apart or less, as stars around shared neighbours.

    Two fingerprints within one bit of the same value differ in two bits at
    most, so all that meet at a value (65 at most) are linked to the least.
    """
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    near = dense.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("z"))
    met = near.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return star.where("a <> b").distinct()


def _segment_table(fps: DataFrame) -> DataFrame:
    return fps.select("fp", "tie", F.explode(F.array(*[_key(_half(F.col("fp"), w), w) for w in HALVES])).alias("key"))


def _probes(fps: DataFrame) -> DataFrame:
    """Each half's ball of radius one: its value, and it with each 0 bit set.

    Of two halves that differ in one bit, one has the 0 there; so setting
    only 0 bits finds each pair from exactly one side.
    """

    def ball(which: int):
        half = _half(F.col("fp"), which)
        bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
        clear = F.filter(bits, lambda bit: half.bitwiseAND(bit) == 0)
        return F.concat(F.array(_key(half, which)), F.transform(clear, lambda bit: _key(half.bitwiseOR(bit), which)))

    return fps.select("fp", "tie", F.explode(F.concat(*[ball(w) for w in HALVES])).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): fingerprint pairs at ``RADIUS`` bits or fewer, enough to reach all that are linked.

    Multi-index hashing: of two halves, one differs in one bit at most if
    the whole differs in three at most.  Balls of radius one around each half
    are looked up in a table of halves, and complete distances are verified in
    the join.  Where many share a half, ties found by ``_ball_ties`` come
    first, and pairs already tied are not made again.  The lookup is always a
    merge of two exchanges: sizes are judged before the balls are spread out,
    some forty rows a fingerprint, which a broadcast would put on the driver.
    """
    bare = fps.select("fp", F.col("fp").alias("tie"))
    crowded = _segment_table(bare).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("key")
    dense = _segment_table(bare).join(crowded, "key", "left_semi").select("fp").distinct()
    ties = _ball_ties(dense)
    tied = connected_components(ties).select(F.col("node").alias("fp"), F.col("root").alias("tie"))
    known = fps.join(tied, "fp", "left").select("fp", F.coalesce("tie", "fp").alias("tie"))
    table = _segment_table(known).select("key", F.col("fp").alias("x"), F.col("tie").alias("x_tie"))
    probe = _probes(known).select("key", F.col("fp").alias("y"), F.col("tie").alias("y_tie"))
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    pairs = table.hint("merge").join(probe.hint("merge"), (table.key == probe.key) & (F.col("x_tie") != F.col("y_tie")) & (apart <= RADIUS))
    found = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return found.union(tied.where("fp <> tie").select(F.col("fp").alias("a"), F.col("tie").alias("b")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` and ``component_id``.

    ``component_id`` is the least id reachable over links of three bits or
    fewer, its own included.  Rows with one fingerprint count once, whatever
    their number.  Texts without words share fingerprint 0 and are linked like
    any others; a null id gets the component of its fingerprint; repeated rows
    stay repeated; an empty table gives no rows; other columns are ignored.  A
    text of any length gives one fingerprint of all its shingles.
    """
    prints = written(fingerprint_table(docs, id_col, text_col, width), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "classes")
    roots = connected_components(links(classes.select("fp")))
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    # written, so that the join is of two plain exchanges and a large component can be split
    least = written(labelled.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    by_print = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
