"""Phrase collocations by contiguous pattern growth (PrefixSpan style).

A phrase can only be frequent if its beginnings are.  So patterns grow to the
right, and only frequent ones do:

1. words are counted; the frequent ones are the prefixes of one word;
2. occurrences of two frequent words in a row are counted: the frequent ones
   are the prefixes of two words;
3. every occurrence of such a prefix is projected to a pointer: what follows
   it, for as long as each next pair of words is a frequent prefix itself;
4. all pointers of one prefix go to one task, which grows it depth-first: in
   their order the pointers are a walk through the tree of continuations, so a
   stack of one path's counts is all that the task holds.

Equal pointers are counted together in the kernels and by Spark before they are
dealt out.  A prefix of many continuations is dealt by its next word too: what
stands below one next word grows without the others.  Which words and pairs are
frequent is told to the tasks by blocked Bloom filters of bounded size; what
they pass by mistake is counted like the rest and falls to its count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.llm.bpe import Codec
from quillstone.llm.url_filter import bit_places, build_filter, filter_blocks
from quillstone.plans.store import small_batches, written

U64 = np.uint64
#: Fixed: bytes that end a piece, and that part its words.
ENDS, GAPS = [*b".,;:!?", *range(0x0A, 0x0E)], [0x20, 0x09]
#: Tasks that one prefix's continuations are dealt to, by next word.
SPREAD = 16
#: Parts of the ranking of one language, each of which leaves its best only.
RANK_PARTS = 64
_WORDS = B.word_table([*ENDS, *GAPS])
_ENDS = ~B.word_table(ENDS)


class _Texts:
    """Lower-cased words of a block: distinct ones by part, and how far each word's piece goes."""

    def __init__(self, batch, block: B.Block):
        words = B.Words(block, _WORDS, lower=True)
        self.n = len(words)
        if not self.n:
            return
        ends = np.cumsum(_ENDS[block.buf])
        # texts end pieces too
        piece = ends[words.start] + words.text_of()
        self.same = piece[1:] == piece[:-1]
        self.buf, self.start, self.end = B.joined(words)
        parts = batch.column(0).slice(block.lo, block.n).dictionary_encode()
        self.parts = parts.dictionary
        self.part_hash = np.array([B.xxh64_spans(np.frombuffer(p.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(p.encode())]))[0] for p in self.parts.to_pylist()], U64)
        self.part = np.asarray(parts.indices)[words.text_of()]
        self.hash = B.xxh64_spans(self.buf, self.start, self.end)
        _, first, code = np.unique(self.hash, return_index=True, return_inverse=True)
        unlike = Codec._unlike(_Buffer(self.buf), self.start, self.end, first[code])
        code[unlike] = len(first) + np.arange(len(unlike))  # words that only share a hash stand for themselves
        self.code = self._numbered(self.part.astype(np.int64), code)

    @staticmethod
    def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for each pair of numbers: equal only if both are."""
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    def chain(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the runs of ``size`` words at the places: equal only for equal runs of one part."""
        out = self.code[at] * 64 + size
        for k in range(1, int(size.max())):
            longer = np.flatnonzero(size > k)
            step = np.zeros(len(at), np.int64)
            step[longer] = self.code[at[longer] + k] + 1
            out = self._numbered(out, step)
        return out

    def counted(self, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        """(part, phrase, n) of the runs of words at the places, equal ones together."""
        _, first, n = np.unique(self.chain(at, size), return_index=True, return_counts=True)
        at, size = at[first], size[first]
        lo, hi = self.start[at], self.end[at + size - 1]
        cut = np.zeros(len(lo) + 1, np.int64)
        np.cumsum(hi - lo, out=cut[1:])
        raw = self.buf[B.ragged(lo, hi - lo)]
        phrase = pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(cut), pa.py_buffer(raw)).cast(pa.string())
        return pa.RecordBatch.from_arrays([self.parts.take(pa.array(self.part[at])), phrase, pa.array(n)], names=["part", "phrase", "n"])

    def keys(self, size: int) -> np.ndarray:
        """Hashes of the runs of ``size`` words at all places, as ``_key`` makes them."""
        if size == 1:
            return self.hash ^ self.part_hash[self.part]
        n = self.n - size + 1
        if n <= 0:
            return np.zeros(0, U64)
        return B.xxh64_spans(self.buf, self.start[:n], self.end[size - 1 :]) ^ self.part_hash[self.part[:n]]


class _Buffer:
    def __init__(self, buf: np.ndarray):
        self.buf = buf


def _key(part: str, phrase: str) -> Column:
    """What the filters hold of a phrase."""
    return F.xxhash64(phrase).bitwiseXOR(F.xxhash64(part))


class _Filter:
    """A blocked Bloom filter of keys, sent to tasks."""

    def __init__(self, known: DataFrame):
        self.blocks = filter_blocks(known.count())
        keys = known.select(_key("part", "phrase").alias("key"))
        self.shared = known.sparkSession.sparkContext.broadcast(build_filter(keys, self.blocks))  # 32 MB at most

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        at = np.arange(len(keys)) * 8
        hashed = B.xxh64_spans(np.ascontiguousarray(keys).view(np.uint8), at, at + 8)
        places = bit_places(hashed, self.blocks)
        return ((self.shared.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def _kernel(select):
    """Arrow batches of (part, text) to counted runs; ``select`` names places and lengths of a block's runs."""

    def run(batches):
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                texts = _Texts(batch, block)
                if not texts.n:
                    continue
                at, size = select(texts)
                if len(at):
                    yield texts.counted(at, size)

    return run


def _all_words(texts: _Texts):
    return np.arange(texts.n), np.ones(texts.n, np.int64)


def _pairs(words: _Filter):
    def select(texts: _Texts):
        often = words.holds(texts.keys(1))
        at = np.flatnonzero(texts.same & often[:-1] & often[1:])
        return at, np.full(len(at), 2, np.int64)

    return select


def _pointers(prefixes: _Filter, longest: int):
    """Runs of three words and more whose pairs may all be frequent, as far as they go."""

    def select(texts: _Texts):
        pair = np.zeros(texts.n, bool)
        pair[:-1] = texts.same
        places = np.flatnonzero(pair)
        pair[places] = prefixes.holds(texts.keys(2)[places]) if len(places) else False
        size = np.where(pair, 2, 1)
        for _ in range(longest - 2):
            follows = np.append(size[1:], 1)
            size = np.where(pair & (follows >= 2), np.minimum(follows + 1, longest), size)
        at = np.flatnonzero(size >= 3)
        return at, size[at]

    return select


def _grow(least: int):
    """Pointers in order of their words -> the frequent phrases of three words and more, depth-first."""

    def run(batches):
        part, path, counts = None, [], []

        def leave(depth: int, out: list) -> None:
            while len(path) > depth:
                n = counts.pop()
                if len(path) >= 3 and n >= least:
                    out.append((part, " ".join(path), n))
                path.pop()
                if counts:
                    counts[-1] += n

        def made(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["part", "phrase", "n"])

        for batch in batches:
            out: list = []
            for p, phrase, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = phrase.split(" ")
                if p != part:
                    leave(0, out)
                    part = p
                same = 0
                for a, b in zip(path, words, strict=False):
                    if a != b:
                        break
                    same += 1
                leave(same, out)
                path += words[same:]
                counts += [0] * (len(path) - len(counts))
                counts[-1] += n
            yield made(out)
        out = []
        leave(0, out)
        yield made(out)

    return run


def frequent_phrases(docs: DataFrame, part: Column, least: int = 10, longest: int = 3, text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two tables (part, phrase, f) and one (part, n): frequent words, frequent phrases of 2 to ``longest`` words, and all words of a part.

    See ``mine`` for what words and pieces are.
    """
    if longest < 2 or longest > 60 or least < 1:
        raise ValueError("phrases have 2 to 60 words, and occur once at least")
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = "part string, phrase string, n bigint"

    def counted(select) -> DataFrame:
        return source.mapInArrow(_kernel(select), made).groupBy("part", "phrase").agg(F.sum("n").alias("f"))

    words = written(counted(_all_words), "words")
    often = written(words.where(F.col("f") >= least), "frequent")
    totals = words.groupBy("part").agg(F.sum("f").alias("n"))
    prefixes = written(counted(_pairs(_Filter(often))).where(F.col("f") >= least), "prefixes")
    if longest == 2:
        return often, prefixes, totals
    pointers = counted(_pointers(_Filter(prefixes), longest)).select("part", "phrase", F.col("f").alias("n"))
    split = F.split("phrase", " ")
    # a prefix is dealt by part of the hash of its next word
    dealt = pointers.withColumn("w", split).withColumn("to", F.pmod(F.xxhash64(F.col("w")[2]), F.lit(SPREAD)))
    dealt = dealt.repartition("part", F.col("w")[0], F.col("w")[1], "to").sortWithinPartitions("part", "w")
    grown = dealt.select("part", "phrase", "n").mapInArrow(_grow(least), made).withColumnRenamed("n", "f")
    return often, written(prefixes.unionByName(grown), "phrases"), totals


def _score(a: str, left: str, right: str) -> str:
    """SQL: floor(1000000 a a / (l r)); exact for counts of up to 16 digits."""
    wide = "CAST({} AS DECIMAL(16, 0))".format
    return f"CAST((1000000 * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)}) AS BIGINT)"


def mine(docs: DataFrame, part: Column, least: int = 10, longest: int = 3, cover: int = 50, top: int | None = None, text_col: str = "text") -> DataFrame:
    """Rows (part, rank, phrase, a, l, r, n, score): phrases of 2 to ``longest`` words, best first.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line
    ends (0A to 0D), pieces into words at space and tab.  Of each part, ``n``
    counts all words; ``a`` is how often a phrase occurs in a row within pieces,
    overlaps included, and ``least`` at least.  Of a phrase's cuts in two, the
    one of least score ``floor(1000000 a a / (l r))`` counts, the first of
    equals; ``l`` and ``r`` are how often its halves occur.  A phrase goes if it
    stands inside a longer one that occurs in ``cover`` percent of its places or
    more, whether that stays or not.  ``rank`` is by score, then a (both
    descending), then phrase in order of its bytes; with ``top`` only so many
    of each part are returned.

    Null texts are empty, a null part is the empty one; repeated rows count
    each; a text or word of any length is taken whole; an empty table gives no
    rows; other columns are ignored.
    """
    often, phrases, totals = frequent_phrases(docs, part, least, longest, text_col)
    known = written(often.unionByName(phrases), "known")
    words = F.split("phrase", " ")
    cuts = phrases.select("part", "phrase", F.col("f").alias("a"), words.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("part", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("tail"))
    heads = known.select("part", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("part", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["part", "head"]).join(tails, ["part", "tail"]).withColumn("score", F.expr(_score("a", "l", "r")))
    best = cuts.groupBy("part", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every shorter run of two words or more inside a phrase
    spans = "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    longer = phrases.select("part", "f", words.alias("w")).where("size(w) > 2").select("part", "f", F.explode(F.expr(spans)).alias("phrase"))
    longer = longer.groupBy("part", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["part", "phrase"], "left").where(~F.coalesce(100 * F.col("longer") >= cover * F.col("a"), F.lit(False)))
    kept = kept.select("part", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = "ORDER BY score DESC, a DESC, phrase"
    if top is not None:
        kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
        kept = kept.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY part, share {order})")).where(F.col("rank") <= top).drop("rank", "share")
        ranked = kept.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY part {order})").cast("bigint")).where(F.col("rank") <= top)
    else:
        ranked = _ranked(kept)
    return ranked.join(totals, "part").select("part", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(kept: DataFrame) -> DataFrame:
    """All phrases with their rank: how many of the part have a better score, and the place among those of one score."""
    kept = written(kept, "kept")
    sizes = kept.groupBy("part", "score").agg(F.count("*").alias("size"))
    # scores are whole numbers up to a million, so a part has so many rows here at most
    above = written(sizes.withColumn("above", F.expr("coalesce(sum(size) OVER (PARTITION BY part ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")), "above")
    place = kept.withColumn("place", F.expr("row_number() OVER (PARTITION BY part, score ORDER BY a DESC, phrase)"))
    return place.join(above, ["part", "score"]).withColumn("rank", (F.col("above") + F.col("place")).cast("bigint")).drop("above", "place", "size")
