"""Benchmark decontamination by winnowing.

The fingerprint of a window of words is the least hash of its k-grams: what
winnowing keeps of a text is the set of its windows' fingerprints.  Two texts
that share a window share its fingerprint, so the fingerprints of corpus and
benchmark are joined, and a hit is extended to its whole window by comparing a
digest of the window's bytes.  With windows of ``WINDOW`` words every shared
span of that length is found.  Items of fewer words are one window of their own
length.

Before the join, a filter of bounded size drops most fingerprints that no item
has; it only ever passes too much.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.plans.store import small_batches, written

WINDOW, GRAM = 10, 5
#: Bits of the filter for each fingerprint, bits it has at least and at most (2 and 32 MB), and places tested of each fingerprint.
MARK_BITS, LEAST_BITS, MOST_BITS = 64, 24, 28
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
U64 = np.uint64


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every run of ``width`` values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def fingerprints(names: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words that lie in one text, and their fingerprints."""
    if len(names) < size:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    k = min(GRAM, size)
    grams = B.span_hashes(names, np.arange(len(names) - k + 1), k)
    least = _slide(grams, size - k + 1, np.minimum)
    at = np.flatnonzero(text[: len(names) - size + 1] == text[size - 1 :])
    return at, least[at]


def _places(marks: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(B.mix64(marks ^ U64(p)) >> U64(64 - bits)).astype(np.int64) for p in PROBES]


class Filter:
    """A Bloom filter of fingerprints."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, np.zeros(1 << (bits - 3), np.uint8)

    def passes(self, marks: np.ndarray) -> np.ndarray:
        out = np.ones(len(marks), bool)
        for at in _places(marks, self.bits):
            out &= (self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def build_filter(marks: DataFrame) -> Filter:
    """The filter of ``marks(mark)``; its bits are set in tasks and come to the driver as a bitmap of at most 32 MB."""
    n = marks.count()
    out = Filter(min(max(LEAST_BITS, int(n * MARK_BITS).bit_length()), MOST_BITS))
    bits = out.bits

    def kernel(batches):
        for batch in batches:
            at = np.concatenate(_places(np.asarray(batch.column(0)).view(U64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["bit"])

    set_bits = marks.select("mark").mapInArrow(kernel, "bit bigint")
    parts = set_bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("held"))
    for row in parts.toLocalIterator():
        at = (row.part - 1) * len(row.held)
        out.held[at : at + len(row.held)] = np.frombuffer(row.held, np.uint8)
    return out


def _item_windows(batches):
    """(item, mark, digest, size) of every window of every item."""
    for batch in batches:
        for block in B.blocks(batch.column(1)):
            words = B.Words(block, B.ALNUM, lower=True)
            if not len(words):
                continue
            names, text, n = words.hashes(), words.text_of(), np.diff(words.first)
            buf, begins, ends = B.joined(words)
            for size in np.unique(np.minimum(n[n > 0], WINDOW)).tolist():
                at, marks = fingerprints(names, text, size)
                own = np.minimum(n[text[at]], WINDOW) == size
                at, marks = at[own], marks[own]
                digests = B.digests(buf, begins[at], ends[at + size - 1])
                items = batch.column(0).take(pa.array(block.lo + text[at]))
                yield pa.RecordBatch.from_arrays([items, pa.array(marks.view(np.int64)), pa.array(digests, pa.binary()), pa.array(np.full(len(at), size, np.int32))], names=["item", "mark", "digest", "size"])


def _document_windows(shared, sizes: list[int], keep: int):
    """keep: columns, after id, body and text, that are handed on as they are."""

    def run(batches):
        filter_ = shared.value
        for batch in batches:
            for block in B.blocks(batch.column(2)):
                words = B.Words(block, B.ALNUM, lower=True)
                names, text = words.hashes(), words.text_of()
                found = []
                for size in sizes:
                    at, marks = fingerprints(names, text, size)
                    likely = filter_.passes(marks)
                    found.append((at[likely], marks[likely], np.full(int(likely.sum()), size, np.int32)))
                at, marks, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int32))
                order = np.argsort(at, kind="stable")
                at, marks, size = at[order], marks[order], size[order]
                if len(at):
                    buf, begins, ends = B.joined(words)
                    digests = B.digests(buf, begins[at], ends[at + size - 1])
                else:
                    digests = []
                owner = text[at]
                cut = np.searchsorted(at, words.first).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array((at - words.first[owner]).astype(np.int64)), pa.array(size), pa.array(marks.view(np.int64)), pa.array(digests, pa.binary())], names=["start", "size", "mark", "digest"])
                part = lambda i: batch.column(i).slice(block.lo, block.n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part(0), part(1), *[part(3 + i) for i in range(keep)], pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), rows)],
                    names=["__id", "__body", *batch.schema.names[3 : 3 + keep], "n_words", "__found"],
                )

    return run


def _union(batches):
    """(id, body, spans as met) -> spans joined where they touch, and the words in them."""
    for batch in batches:
        spans, n_hit = [], []
        for met in batch.column(2).to_pylist():
            out: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in met):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(b, out[-1][1])
                else:
                    out.append([a, b])
            spans.append([{"start": a, "end": b} for a, b in out])
            n_hit.append(sum(b - a for a, b in out))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(spans, kind)], names=["__id", "__body", "n_hit", "spans"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the columns in ``keep``, ``n_words``, ``n_hit``, ``items``, ``spans``.

    ``items`` are the ids, as sorted strings, of benchmark items of which some
    window occurs; ``spans`` are the hit words, as [start, end) word numbers.
    A null or empty text has no words.  Items without id or words match
    nothing; repeated items count once; repeated documents stay repeated.
    With an empty benchmark nothing is hit.  Other columns are ignored.

    Windows that the same items hold form one class, so what is joined follows
    the windows met and the items found, however many items share a passage.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    held = written(items.mapInArrow(_item_windows, "item string, mark bigint, digest binary, size int").distinct(), "item_windows")
    sizes = sorted(r.size_ for r in held.select(F.col("size").alias("size_")).distinct().collect())  # WINDOW at most
    shared = spark.sparkContext.broadcast(build_filter(held.select("mark").distinct()))
    # windows by the set of items that hold them; a class is named by its least window
    owned = held.groupBy("digest", "mark").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.sum(F.xxhash64(F.lit("again"), "item").cast("decimal(38,0)")).alias("s"))
    owned = written(owned, "owned")
    named = written(owned.groupBy("n", "x", "s").agg(F.min("digest").alias("cls")), "classes")
    windows = written(owned.join(named, ["n", "x", "s"]).select("mark", "digest", "cls"), "windows")
    members = written(held.select("digest", "item").join(named.select(F.col("cls").alias("digest")), "digest").select(F.col("digest").alias("cls"), "item"), "members")

    body = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    handed = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    rows = docs.select(F.col(id_col).alias("__id"), body.alias("__body"), F.col(text_col).cast("string").alias("__text"), *keep)
    scanned = rows.mapInArrow(_document_windows(shared, sizes, len(keep)), f"__id {kind}, __body bigint, {handed}n_words bigint, __found array<struct<start:bigint,size:int,mark:bigint,digest:binary>>")
    scanned = written(scanned, "scanned")
    likely = scanned.where("size(__found) > 0")
    probes = likely.select("__id", "__body", F.inline("__found")).distinct()
    hits = written(probes.join(windows, ["mark", "digest"]).select("__id", "__body", F.col("start"), (F.col("start") + F.col("size")).alias("end"), "cls"), "hits")
    spans = hits.groupBy("__id", "__body").agg(F.collect_set(F.struct("start", "end")).alias("met")).mapInArrow(_union, f"__id {kind}, __body bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>")
    of = hits.select("__id", "__body", "cls").distinct().join(members, "cls").select("__id", "__body", "item").distinct()
    of = of.groupBy("__id", "__body").agg(F.array_sort(F.collect_list("item")).alias("items"))
    of = of.select(F.col("__id").alias("i2"), F.col("__body").alias("b2"), "items")
    met = spans.join(of, F.col("__id").eqNullSafe(F.col("i2")) & (F.col("__body") == F.col("b2"))).select(F.col("__id").alias("i"), F.col("__body").alias("b"), "n_hit", "items", "spans")
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:bigint,end:bigint>>")
    columns = ["__id", *keep, "n_words", "n_hit", "items", "spans"]
    clear = scanned.where("size(__found) = 0").select("__id", *keep, "n_words", F.lit(0).cast("bigint").alias("n_hit"), no_items.alias("items"), no_spans.alias("spans"))
    joined = likely.join(met, likely["__id"].eqNullSafe(F.col("i")) & (likely["__body"] == F.col("b")), "left")
    hit = joined.select("__id", *keep, "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", no_items).alias("items"), F.coalesce("spans", no_spans).alias("spans"))
    return clear.select(columns).unionByName(hit.select(columns)).withColumnRenamed("__id", id_col)
