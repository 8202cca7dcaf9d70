"""Substring deduplication by recompression.

Rounds of renaming turn word sequences into ever shorter symbol sequences:
the first names runs of one word, every round names pairs whose left symbol
falls in one half of the alphabet and whose right symbol in the other.  Names
are hashes of what they stand for, so all tasks give equal content equal names
without talking to each other.

What a symbol becomes depends on its neighbours only.  Of a window of words,
the symbols that its words alone determine (its core) lose no more than one on
each side per step, whatever stands around the window.  The longest symbol in
the core after the last round is therefore the same wherever the window
occurs: its anchor.  A window that repeats a short period has no such symbol that is
its own; its anchor is the period itself.  Spark then joins on anchors:

1. anchors found in one document only are dropped;
2. the words that all windows of one anchor occurrence cover (its span) are
   compared by a digest of their bytes: a span that an earlier document has is
   a repeat as a whole;
3. of anchors with unlike spans, the windows of one document per span are
   compared one by one, by digests of their bytes too.

So a name only says what may be equal; nothing is removed on names alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.plans.store import small_batches, written

U64 = np.uint64
WINDOW = 50
#: Rounds, as many as leave a symbol whole inside a core of ``WINDOW`` words: each makes symbols about 3/2 as long.
ROUNDS = 4
#: Rounds that name runs before they name pairs.
RUN_ROUNDS = frozenset({0})


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return B.mix64(a * U64(0xBF58476D1CE4E5B9) + ((b << U64(29)) | (b >> U64(35))) + U64(salt * 0x94D049BB133111EB % (1 << 64)))


class _Level:
    """Symbols of one round: names, the text that each belongs to, and how many words each stands for."""

    def __init__(self, name: np.ndarray, text: np.ndarray, size: np.ndarray):
        self.name, self.text, self.size = name, text, size


def _named_runs(level: _Level) -> tuple[_Level, np.ndarray]:
    """Runs of one symbol become one; and for each old symbol its new number."""
    fresh = np.ones(len(level.name), bool)
    fresh[1:] = (level.name[1:] != level.name[:-1]) | (level.text[1:] != level.text[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(level.name)))
    name = level.name[first]
    name = np.where(count > 1, _pair(name, count.astype(U64), 1), name)
    return _Level(name, level.text[first], level.size[first] * count), np.cumsum(fresh) - 1


def _sides(name: np.ndarray, round_: int) -> np.ndarray:
    """Which half of the alphabet each symbol is in, this round: True for left."""
    return (B.mix64(name ^ U64((round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(63)) == 0


def _named_pairs(level: _Level, left: np.ndarray, round_: int) -> tuple[_Level, np.ndarray]:
    joins = np.zeros(len(level.name), bool)
    joins[:-1] = left[:-1] & ~left[1:] & (level.text[1:] == level.text[:-1])
    at = np.flatnonzero(joins)
    name = level.name.copy()
    name[at] = _pair(name[at], name[at + 1], round_ + 2)
    size = level.size.copy()
    size[at] += size[at + 1]
    keep = np.ones(len(name), bool)
    keep[at + 1] = False
    return _Level(name[keep], level.text[keep], size[keep]), np.cumsum(keep) - 1


def _least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least value in each [lo, hi), the first of equals; by a table of powers of two."""
    reach = int((hi - lo).max())
    tables = [np.arange(len(values))]
    while 2 ** len(tables) <= reach:
        half, below = 2 ** (len(tables) - 1), tables[-1]
        a, b = below[: len(below) - half], below[half:]
        tables.append(np.where(values[b] < values[a], b, a))
    out = np.empty(len(lo), np.int64)
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1
    for k, table in enumerate(tables):
        rows = np.flatnonzero(power == k)
        a, b = table[lo[rows]], table[hi[rows] - 2**k]
        out[rows] = np.where(values[b] < values[a], b, a)
    return out


def _periodic(names: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows that repeat something of at most half their length, and a name of what they repeat.

    The name is that of the least rotation of the shortest period, so all windows
    of one repetition have one name, at whatever phase they begin.
    """
    name, open_ = np.zeros(len(start), U64), np.ones(len(start), bool)
    for p in range(1, window // 2 + 1):
        unlike = np.zeros(len(names) - p + 1, np.int64)
        np.cumsum(names[:-p] != names[p:], out=unlike[1:])
        rows = np.flatnonzero(open_ & (unlike[np.minimum(start + window - p, len(names) - p)] == unlike[start]))
        if len(rows):
            name[rows] = _pair(np.min([B.span_hashes(names, start[rows] + r, p) for r in range(p)], axis=0), np.full(len(rows), p, U64), 97)
            open_[rows] = False
    return np.flatnonzero(~open_), name


def anchors(names: np.ndarray, text: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows, in order: first word, anchor name, and a number of the anchor's place.

    The anchor is the core's longest symbol, in words, and of equals the one
    of least name; all windows with one place number share one occurrence of it.
    Windows that repeat a short period are named after it: a repetition of any
    length is one occurrence.
    """
    n = len(names)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    start = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    level = _Level(names, text, np.ones(n, np.int64))
    rows, lo, hi = np.arange(len(start)), start.copy(), start + window

    def shrunk(rows, lo, hi):
        ok = lo < hi
        return (rows, lo, hi) if ok.all() else (rows[ok], lo[ok], hi[ok])

    for round_ in range(ROUNDS):
        if round_ in RUN_ROUNDS:
            # a first or last run may go on outside
            level, at = _named_runs(level)
            rows, lo, hi = shrunk(rows, at[lo] + 1, at[hi - 1])
        left = _sides(level.name, round_)
        # a first symbol that may join what stands before, or a last one what stands after, leaves the core
        rows, lo, hi = shrunk(rows, lo + ~left[lo], hi)
        rows, lo, hi = shrunk(rows, lo, hi - left[hi - 1])
        level, at = _named_pairs(level, left, round_)
        lo, hi = at[lo], at[hi - 1] + 1
    # a window that has lost its core is named after all of its words
    anchor = B.span_hashes(names, start, window)
    repeats, period = _periodic(names, start, window)
    anchor[repeats] = period[repeats]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(start) > 1) | (text[start[1:]] != text[start[:-1]])
    place = -1 - np.cumsum(fresh)
    if len(repeats):
        whole = np.ones(len(start), bool)
        whole[repeats] = False
        keep = whole[rows]
        rows, lo, hi = rows[keep], lo[keep], hi[keep]
    if len(rows):
        rank = (U64(255) - np.minimum(level.size, 255).astype(U64) << U64(56)) | (level.name >> U64(8))
        best = _least_in(rank, lo, hi)
        anchor[rows], place[rows] = level.name[best], best
    return start, anchor, place


def _rows(batch, block: B.Block, column: int, values: np.ndarray):
    """A column's entries for texts of a block, by their numbers."""
    return batch.column(column).take(pa.array(block.lo + values))


def _anchor_kernel(window: int):
    def run(batches):
        for batch in batches:
            for block in B.blocks(batch.column(2)):
                words = B.Words(block, B.SPACED)
                if not len(words):
                    continue
                names, text = words.hashes(), words.text_of()
                start, anchor, place = anchors(names, text, window)
                if not len(start):
                    continue
                order = np.lexsort((start, place))
                first = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0]))
                last = np.append(first[1:], len(order)) - 1
                lo, hi, name = start[order[first]], start[order[last]], anchor[order[first]]
                buf, begins, ends = B.joined(words)
                span = B.digests(buf, begins[lo], ends[hi + window - 1])
                owner = text[lo]
                begin = words.first[owner]
                yield pa.RecordBatch.from_arrays(
                    [_rows(batch, block, 0, owner), _rows(batch, block, 1, owner), pa.array(name.view(np.int64)), pa.array(span, pa.binary()), pa.array((lo - begin).astype(np.int32)), pa.array((hi - begin).astype(np.int32))],
                    names=["doc", "body", "anchor", "span", "lo", "hi"],
                )

    return run


def _window_kernel(window: int):
    def run(batches):
        for batch in batches:
            ranges = batch.column(3).to_pylist()
            for block in B.blocks(batch.column(2)):
                words = B.Words(block, B.SPACED)
                starts = []
                for i in range(block.n):
                    own = np.zeros(int(words.first[i + 1] - words.first[i]) + 1, np.int64)
                    for r in ranges[block.lo + i]:
                        own[r["lo"]] += 1
                        own[r["hi"] + 1] -= 1
                    starts.append(words.first[i] + np.flatnonzero(np.cumsum(own)[:-1]))
                at = np.concatenate(starts)
                if not len(at):
                    continue
                owner = words.text_of()[at]
                buf, begins, ends = B.joined(words)
                digest = B.digests(buf, begins[at], ends[at + window - 1])
                yield pa.RecordBatch.from_arrays(
                    [_rows(batch, block, 0, owner), _rows(batch, block, 1, owner), pa.array(digest, pa.binary()), pa.array((at - words.first[owner]).astype(np.int32))],
                    names=["doc", "body", "digest", "lo"],
                )

    return run


def _removal_kernel(window: int):
    def run(batches):
        for batch in batches:
            ranges = batch.column(2).to_pylist()
            n_words, n_removed, kept = [], [], []
            for block in B.blocks(batch.column(1)):
                words = B.Words(block, B.SPACED)
                buf, start, end = B.joined(words)
                view = buf.tobytes()
                for i in range(block.n):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    gone = np.zeros(b - a + 1, np.int64)
                    for r in ranges[block.lo + i] or ():
                        gone[r["lo"]] += 1
                        gone[r["hi"] + window] -= 1
                    stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                    n_words.append(b - a)
                    n_removed.append(b - a - len(stay))
                    if not len(stay):
                        kept.append(b"")
                        continue
                    breaks = np.flatnonzero(np.diff(stay) > 1)
                    heads, tails = start[stay[np.concatenate([[0], breaks + 1])]], end[stay[np.append(breaks, len(stay) - 1)]]
                    kept.append(b" ".join([view[x:y] for x, y in zip(heads.tolist(), tails.tolist(), strict=True)]))
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], names=["id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept``.

    Every word goes that lies in some ``window`` consecutive words which also
    start in a document of smaller id; windows are those of the input.
    ``kept`` is the remaining words, joined by one space.  A null text counts as
    empty; a document without id stays whole and counts for no other; rows
    of one id are judged against smaller ids only, each by its own text; an
    empty table gives no rows; other columns are ignored.  A text of any length
    is taken whole.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))
    key = ["doc", "body"]
    found = written(source.where("doc is not null").mapInArrow(_anchor_kernel(window), f"doc {kind}, body bigint, anchor bigint, span binary, lo int, hi int"), "anchors")
    # tables that others are joined with are written first: a join of two plain exchanges can split a hot key
    met = written(found.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor"), "met")
    shared = written(found.join(met, "anchor", "left_semi"), "shared")
    first = written(shared.groupBy("anchor", "span").agg(F.min("doc").alias("first_doc")), "first")
    spans = written(shared.join(first, ["anchor", "span"]), "spans")
    whole = spans.where("doc > first_doc").select(*key, "lo", "hi")
    unlike = written(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "unlike")
    open_ = spans.where("doc = first_doc").join(unlike, "anchor", "left_semi")
    open_ = open_.groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    singles = source.join(open_, key).select(*key, "text", "ranges").mapInArrow(_window_kernel(window), f"doc {kind}, body bigint, digest binary, lo int")
    singles = written(singles, "windows")
    earlier = written(singles.groupBy("digest").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b"), "earlier")
    one = singles.join(earlier, "digest").where("doc > a").select(*key, "lo", F.col("lo").alias("hi"))
    ranges = written(whole.union(one).groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    out = source.join(ranges, key, "left").select(F.col("doc").alias("id"), "text", "ranges")
    return out.mapInArrow(_removal_kernel(window), f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)
