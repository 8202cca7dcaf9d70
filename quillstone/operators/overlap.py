"""Which windows of words a document shares with an earlier one, and how much of it they cover.

1. A rolling polynomial hash modulo 2**64 runs over the words' names; of each
   window the least hash of its shorter runs stands for it.  Neighbouring
   windows mostly have the same one, so a document leaves few values, and equal
   windows always leave the same.
2. Values that two documents leave are put into a Bloom filter of bounded size.
3. Only windows whose value may be shared are named by all their words (128
   bits) and compared: hashes alone decide nothing.
4. A document's shared places are swept in order: each adds what the next does
   not cover.

No row holds a window's text, and none is made for windows without a partner.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import bloom
from quillstone.operators.grams import BASE, binary, gram_names, names_at, occurrences, rolling, words_of  # noqa: F401
from quillstone.plans.store import shuffles_dropped, small_batches, written

U64 = np.uint64


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of every ``reach`` neighbours."""
    span, out = 1, values
    while 2 * span <= reach:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    rest = reach - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def windows(row: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of n words in order: the first word's place, and the value that stands for it."""
    if len(names) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    short = max(1, n // 2)
    hashes = rolling(names[:, 0], short)
    value = _least((hashes ^ (hashes >> U64(31))) * U64(0xBF58476D1CE4E5B9), n - short + 1)
    at = np.flatnonzero(row[: len(names) - n + 1] == row[n - 1 :])
    return at, value[at]


def held(row: np.ndarray, names: np.ndarray, n: int, filter_: bloom.Bloom) -> np.ndarray:
    """Places of the windows whose value the filter holds; neighbours of one value are asked once."""
    at, value = windows(row, names, n)
    if not len(at):
        return at
    turn = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    return at[np.repeat(filter_.holds(value[turn]), np.diff(np.append(turn, len(at))))]


def first_places(row: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether a place is the first of its row to hold its name; places in order."""
    out = np.zeros(len(row), np.int64)
    order = np.argsort(names[:, 0] ^ (row.astype(U64) * U64(BASE)), kind="stable")
    same = (names[order[1:], 0] == names[order[:-1], 0]) & (row[order[1:]] == row[order[:-1]])
    if (same & (names[order[1:], 1] != names[order[:-1], 1])).any():  # halves alike, names not
        order = np.lexsort((names[:, 1], names[:, 0], row))
        same = (names[order[1:]] == names[order[:-1]]).all(axis=1) & (row[order[1:]] == row[order[:-1]])
    out[order[np.append(True, ~same)[: len(order)]]] = 1
    return out


def left_values(row: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): what stands for the windows of each row, neighbours of one value once."""
    at, value = windows(row, names, n)
    turn = np.append(True, (value[1:] != value[:-1]) | (row[at[1:]] != row[at[:-1]])) if len(at) else np.zeros(0, bool)
    return row[at[turn]], value[turn].view(np.int64)


def shared_windows(docs: DataFrame, words: Column, n: int = 20, id_col: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: id, ``n_words``, ``windows``, ``matched``, ``matches``, ``covered``.

    A window is ``n`` words in a row.  ``windows`` counts a row's different ones,
    ``matched`` those of them that also stand in a document of smaller id,
    ``matches`` the places of such, ``covered`` the words that they cover.

    ``words`` is an array of words; null has none.  A row without id matches
    nothing and is matched by nothing; rows of one id are judged each by its own
    text against smaller ids; a text of any length is taken whole; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    w = F.coalesce(F.filter(words, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    # the name of a row's words keeps texts of one id apart
    source = docs.select(F.col(id_col).alias("doc"), w.alias("w")).select("doc", F.xxhash64("w").alias("body"), "w")
    known = source.where("doc is not null")

    def values(batches):
        for batch in batches:
            row, value = left_values(*words_of(batch.column(2)), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(value)], names=["doc", "value"])

    left = known.mapInArrow(values, f"doc {kind}, value bigint")
    met = written(left.groupBy("value").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("value"), "met")
    filter_ = spark.sparkContext.broadcast(bloom.build(met, met.count()))

    def places(batches):
        for batch in batches:
            lists = batch.column(2)
            row, words = words_of(lists)
            at = held(row, words, n, filter_.value)
            lo = at - (np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py())[row[at]]
            of, none, names = pa.array(row[at]), pa.nulls(len(at), pa.int64()), names_at(words, at, n)
            place = 2 * lo + first_places(row[at], names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), binary(names), pa.array(place), none, none], names=kinds)
            size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            _, different, _ = occurrences(row, words, len(lists), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(len(lists), pa.binary()), pa.nulls(len(lists), pa.int64()), pa.array(size), pa.array(different)], names=kinds)

    # one pass for shared places (twice the first word's, and one if the row has the window first there) and for the
    # sizes of rows, which have no place; written: counted, then joined with what was counted, as two plain exchanges
    # that can be split
    kinds = ["doc", "body", "name", "place", "n_words", "windows"]
    both = written(source.mapInArrow(places, f"doc {kind}, body bigint, name binary, place bigint, n_words bigint, windows bigint"), "places")
    candidates = both.where("place is not null and doc is not null").select("doc", "body", "name", "place")
    first = written(candidates.groupBy("name").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("b")).where("first_doc < b").select("name", "first_doc"), "first")
    hits = candidates.join(first, "name").where("doc > first_doc")
    swept = hits.groupBy("doc", "body").agg(F.sort_array(F.collect_set("place")).alias("places"))
    swept = swept.select("doc", "body", F.expr("transform(places, p -> p div 2)").alias("at"), F.expr("CAST(size(filter(places, p -> p % 2 = 1)) AS BIGINT)").alias("matched"))
    cover = f"aggregate(transform(at, (p, i) -> CAST(least({n}, coalesce(get(at, i + 1) - p, {n})) AS BIGINT)), 0L, (s, x) -> s + x)"
    swept = written(swept.select("doc", "body", "matched", F.size("at").cast("bigint").alias("matches"), F.expr(cover).alias("covered")), "swept")
    measured = both.where("place is null").select("doc", "body", "n_words", "windows")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("matched", "matches", "covered")]
    return measured.join(swept, ["doc", "body"], "left").select(F.col("doc").alias(id_col), "n_words", "windows", *zero)


#: Rounds in which grams meet: each holds its share of their names on disk, and passes over the texts.
ROUNDS = 2
#: Bytes of text whose grams meet in one task, about.
PART_BYTES = 1 << 24
#: Bytes of a name that are sent; its part is told by the first of them.
NAME_BYTES = 12


def _packed(ids: np.ndarray, row: np.ndarray, names: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """A row for each part: the ids of its grams' rows as differences, byte by byte, and their names."""
    ranked = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[ranked] = np.arange(len(ids))
    order = np.argsort(part * max(1, len(ids)) + rank[row], kind="stable")
    part, of = part[order], ids[row[order]]
    raw = np.empty((len(order), NAME_BYTES), np.uint8)
    raw[:] = np.ascontiguousarray(names[order]).view(np.uint8).reshape(-1, 16)[:, :NAME_BYTES]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(at, len(part))
    docs = [np.diff(of[lo:hi], prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    held = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * NAME_BYTES).astype(np.int32)), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(docs, pa.binary()), held, pa.nulls(len(at), pa.binary())], names=["part", "docs", "names", "sizes"])


def _ids(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _owned(docs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, m, n): of each id, the grams that a smaller id is the first to hold, by that id."""
    raw = raw.reshape(-1, NAME_BYTES)
    a, b = np.ascontiguousarray(raw[:, :8]).view("<u8").ravel(), np.ascontiguousarray(raw[:, 8:]).view("<u4").ravel()
    order = np.argsort(a)
    same = a[order[1:]] == a[order[:-1]]
    if (same & (b[order[1:]] != b[order[:-1]])).any():  # halves alike, names not
        order = np.lexsort((b, a))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    fresh = np.append(True, ~same)[: len(order)]
    at = np.flatnonzero(fresh)
    docs = docs[order]
    least = np.minimum.reduceat(docs, at) if len(at) else docs
    first = np.repeat(least, np.diff(np.append(at, len(docs))))
    doc, m = docs[docs > first], first[docs > first]
    order = np.lexsort((m, doc))
    doc, m = doc[order], m[order]
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (m[1:] != m[:-1]))[: len(doc)])
    return doc[at], m[at], np.diff(np.append(at, len(doc)))


def first_owner_jaccard(docs: DataFrame, words: Column, n: int, bulk: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, other, jaccard): each row with every smaller id that is the first to hold one of its n-word grams.

    Shared are the grams whose first holder ``other`` is; the union is that of
    both gram sets, less those.  Rows of one id count as the SQL does: each row's
    grams, and each pair of rows.  Null ids match nothing; ids are integers.
    ``bulk`` is the bytes of a row's words, about: it tells how many tasks the
    grams need.

    All grams meet by their names, 96 bits of them, in ``ROUNDS`` rounds, packed
    by the part of the names' range that a task takes: 13 bytes a gram, and no
    more if all are shared.  What a task leaves are counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    known = docs.where(F.col(id_col).isNotNull())
    source = known.select(F.col(id_col).cast("bigint").alias("doc"), words.alias("w"))
    size = known.agg(F.sum(bulk.cast("bigint"))).first()[0] or 0
    each = max(-(-size // PART_BYTES // ROUNDS), spark.sparkContext.defaultParallelism)

    def sent(round_: int):
        def kernel(batches):
            for batch in batches:
                ids = np.asarray(batch.column(0))
                row, names = gram_names(batch.column(1), n)
                if round_:
                    part = _part(names, each)
                    mine = part // each == round_
                    row, names = row[mine], names[mine]
                new = first_places(row, names).astype(bool)
                row, names = row[new], names[new]
                if not round_ and len(ids):
                    sizes = np.bincount(row, minlength=len(ids)).astype("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[0]) % each], pa.int32()), pa.array([np.diff(ids, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([sizes.tobytes()], pa.binary())], names=["part", "docs", "names", "sizes"])
                part = _part(names, each)
                mine = part // each == round_
                yield _packed(ids, row[mine], names[mine], part[mine] % each)

        return kernel

    def met(batches):
        ids, names = [], []
        for batch in batches:
            for d, x, s in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if s is None:
                    ids.append(_ids(d))
                    names.append(np.frombuffer(x, np.uint8))
                else:
                    yield _counts(_ids(d), None, np.frombuffer(s, "<i8"))
        if ids:
            yield _counts(*_owned(np.concatenate(ids), np.concatenate(names)))

    counts = []
    for k in range(ROUNDS):
        packed = source.mapInArrow(sent(k), "part int, docs binary, names binary, sizes binary")
        with shuffles_dropped(spark):
            counts.append(written(packed.repartitionById(each, F.col("part")).mapInArrow(met, "doc bigint, m bigint, n bigint"), "owned"))
    both = reduce(DataFrame.unionByName, counts)
    size = both.where("m is null").select("doc", F.col("n").alias("p"))
    hits = both.where("m is not null").groupBy("doc", "m").agg(F.sum("n").alias("n"))
    out = hits.join(size, "doc").join(size.select(F.col("doc").alias("m"), F.col("p").alias("q")), "m")
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("m").cast(kind).alias("other"), (F.col("n").cast("double") / (F.col("p") + F.col("q") - F.col("n"))).alias("jaccard"))


def _part(names: np.ndarray, each: int) -> np.ndarray:
    """Which of ``ROUNDS * each`` equal ranges a name's first 32 bits are in."""
    return ((names[:, 0] >> U64(32)) * U64(ROUNDS * each) >> U64(32)).astype(np.int64)


def _counts(doc: np.ndarray, m: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.nulls(len(doc), pa.int64()) if m is None else pa.array(m), pa.array(n, pa.int64())], names=["doc", "m", "n"])
