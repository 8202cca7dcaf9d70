"""Byte-level BPE encoding and decoding with a given vocabulary.

Pre-tokens are found by character class over whole buffers.  Each distinct
pre-token of a block is looked up in two tiers: a minimal perfect hash of the
vocabulary resolves those that are tokens themselves; the others are merged
with a heap over a linked list of their bytes.  Nothing is trained here: the
ranks come from a file whose path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.plans.store import small_batches

U64 = np.uint64
SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
#: Pre-tokens that are kept merged between blocks, in each of two generations.
MEMO = 80_000

#: Fixed: the code points of the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fixed: what may follow an apostrophe as one pre-token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def class_table() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of ``base64 rank`` lines; ranks must run from 0 without gaps."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    known = set(tokens.values())
    if sorted(tokens) != list(range(len(tokens))) or not all(bytes([b]) in known for b in range(256)):
        raise ValueError("ranks must be 0..n-1 and hold every single byte")
    return [tokens[i] for i in range(len(tokens))]


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: value -> its index.

    Values fall into buckets; each bucket, largest first, gets the first
    displacement that sends its values to free slots.  As many slots as values.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(np.unique(values)) != n:
            raise ValueError("two tokens have one hash")
        self.n, self.buckets = n, max(1, n // 3)
        self.shift = np.zeros(self.buckets, np.int64)
        self.item = np.full(max(n, 1), -1, np.int64)
        bucket = (values % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if n else []
        free = np.ones(max(n, 1), bool)
        tries = np.arange(1, 257, dtype=np.int64)
        for group in sorted(groups, key=len, reverse=True):
            if len(group) == 1:
                break
            base = 0
            while True:
                slots = self._slot(values[group][None, :], (tries + base)[:, None])
                fits = free[slots].all(axis=1)
                if len(group) > 1:
                    fits &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    self.shift[bucket[group[0]]] = tries[k] + base
                    self.item[slots[k]] = group
                    free[slots[k]] = False
                    break
                base += len(tries)
        # single values go straight to what is left: a negative shift names the slot
        left = iter(np.flatnonzero(free[:n]).tolist())
        for group in groups:
            if len(group) == 1:
                slot = next(left)
                self.shift[bucket[group[0]]] = -slot - 1
                self.item[slot] = group[0]

    def _slot(self, values: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (B.mix64(values ^ (shift.astype(U64) * U64(0x9FB21C651E98DF25))) % U64(max(self.n, 1))).astype(np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """The only index that each value can have; the caller compares."""
        shift = self.shift[(values % U64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._slot(values, np.maximum(shift, 0)))
        return self.item[slot]


class Codec:
    """A vocabulary ready for encoding and decoding; sent to workers once."""

    def __init__(self, tokens: list[bytes]):
        self.ranks = {t: i for i, t in enumerate(tokens)}
        size = np.array([len(t) for t in tokens], np.int64)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.hashes = B.xxh64_spans(self.blob, self.start, self.end)
        self.perfect = PerfectHash(self.hashes)
        self.classes = class_table()
        digits = [str(i).encode() + b" " for i in range(len(tokens))]
        wide = max(map(len, digits))
        self.digits = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in digits), np.uint8).reshape(-1, wide)
        self.digit_size = np.array([len(x) for x in digits], np.int64)
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    def pretokens(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of every pre-token of a block."""
        buf = block.buf
        heads = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.classes[points]
        gaps = block.at[1:] - 1 if len(heads) == len(buf) else np.searchsorted(heads, block.at[1:] - 1)
        kind[gaps] = BREAK
        change = np.ones(len(kind), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[gaps] = True
        begin = np.flatnonzero(change)
        stop = np.append(begin[1:], len(kind))
        cls = kind[begin]
        after = np.append(cls[1:], BREAK)
        # of white space before anything else, the last character stands apart, and joins if it is a space
        blank = cls == SPACE
        inner = blank & (after != BREAK)
        last = stop - 1
        joins = inner & (points[last] == 0x20)
        begin2 = begin.copy()
        begin2[1:] -= joins[:-1]
        stop2 = np.where(inner, last, stop)
        alone = inner & ~joins
        # an apostrophe that stands alone takes s, t, re, ve, m, ll or d with it
        quote = np.flatnonzero((cls == OTHER) & (begin2 == begin) & (stop - begin == 1) & (points[begin] == 0x27) & (after == LETTER))
        if len(quote):
            first, room = stop[quote], stop[quote + 1] - stop[quote]
            one, two = points[first], np.where(room > 1, points[np.minimum(first + 1, len(points) - 1)], 0)
            take = np.zeros(len(quote), np.int64)
            for suffix in CONTRACTIONS:
                same = one == ord(suffix[0])
                if len(suffix) == 2:
                    same &= two == ord(suffix[1])
                take[same & (take == 0)] = len(suffix)
            stop2[quote] += take
            begin2[quote + 1] += take
        start = np.concatenate([begin2, last[alone]])
        end = np.concatenate([stop2, stop[alone]])
        keep = np.concatenate([cls != BREAK, np.ones(int(alone.sum()), bool)]) & (end > start)
        start, end = start[keep], end[keep]
        order = np.argsort(start, kind="stable") if alone.any() else slice(None)
        start, end = start[order], end[order]
        ends = np.append(heads, len(buf))
        return ends[start], ends[end]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ranks of one pre-token: the lowest-ranked neighbours are merged first, the leftmost of equals."""
        n, ranks = len(piece), self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i, size = pop(heap)
            a = parts[i]
            j = right[i]
            if a is None or j >= n or len(a) + len(parts[j]) != size:
                continue  # one side has changed since
            merged = a + parts[j]
            parts[i], parts[j] = merged, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                rank = ranks.get(merged + parts[k])
                if rank is not None:
                    push(heap, (rank, i, size + len(parts[k])))
            h = left[i]
            if h >= 0:
                rank = ranks.get(parts[h] + merged)
                if rank is not None:
                    push(heap, (rank, h, size + len(parts[h])))
        return tuple([ranks[p] for p in parts if p is not None])

    def _remembered(self, piece: bytes) -> tuple[int, ...]:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = self.merge(piece)
            if len(piece) <= 64:
                if len(self.young) >= MEMO:
                    self.old, self.young = self.young, {}
                self.young[piece] = ids
        return ids

    @staticmethod
    def _unlike(block: B.Block, start: np.ndarray, end: np.ndarray, model: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those of the piece numbered ``model``."""
        size = end - start
        bad = size != size[model]
        at = np.flatnonzero(~bad & (model != np.arange(len(model))))
        if len(at):
            n = size[at]
            same = block.buf[B.ragged(start[at], n)] == block.buf[B.ragged(start[model[at]], n)]
            bad[at] = ~np.logical_and.reduceat(same, np.cumsum(n) - n)
        return np.flatnonzero(bad)

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and where each text's begin (n + 1 entries)."""
        start, end = self.pretokens(block)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64)
        hashes, first, code = np.unique(B.xxh64_spans(block.buf, start, end), return_index=True, return_inverse=True)
        unlike = self._unlike(block, start, end, first[code])
        if len(unlike):  # pieces that only share a hash with their class's first stand for themselves
            code[unlike] = len(first) + np.arange(len(unlike))
            first, hashes = np.append(first, unlike), np.append(hashes, B.xxh64_spans(block.buf, start[unlike], end[unlike]))
        s, e = start[first], end[first]
        found = self.perfect(hashes)
        size = self.end[found] - self.start[found]
        match = size == e - s
        at = np.flatnonzero(match)
        same = block.buf[B.ragged(s[at], size[at])] == self.blob[B.ragged(self.start[found[at]], size[at])]
        match[at] = np.logical_and.reduceat(same, np.cumsum(size[at]) - size[at]) if len(at) else False
        raw = block.buf.tobytes()
        misses = np.flatnonzero(~match)
        merged = [self._remembered(raw[a:b]) for a, b in zip(s[misses].tolist(), e[misses].tolist(), strict=True)]
        count = np.ones(len(s), np.int64)
        count[misses] = [len(m) for m in merged]
        at = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int64)
        flat[at[match]] = found[match]
        if merged:
            flat[B.ragged(at[misses], count[misses])] = np.fromiter((i for m in merged for i in m), np.int64)
        per = count[code]
        ids = flat[B.ragged(at[code], per)]
        cut = np.zeros(len(per) + 1, np.int64)
        np.cumsum(per, out=cut[1:])
        return ids, cut[np.searchsorted(start, block.at)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text's begin."""
        size = self.end[ids] - self.start[ids]
        cut = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=cut[1:])
        return self.blob[B.ragged(self.start[ids], size)], cut[first]

    def decimal(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, a space after each, and where each text's begin."""
        size = self.digit_size[ids]
        cut = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=cut[1:])
        rows = self.digits[ids]
        return rows[rows != 0], cut[first]


def _digests(buf: np.ndarray, first: np.ndarray, trim: int = 0) -> list[str]:
    view, at = memoryview(buf), first.tolist()
    return [hashlib.sha256(view[a : max(a, b - trim)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]


def _shared(df: DataFrame, vocabulary: str):
    """The vocabulary, a file on the driver, as a broadcast; it has some 50,000 entries whatever the data."""
    return df.sparkSession.sparkContext.broadcast(Codec(read_ranks(vocabulary)))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of every text.  Null and empty texts have none.  Rows stay as they are, repeated or not."""
    small_batches(docs.sparkSession)
    shared = _shared(docs, vocabulary)

    def kernel(batches):
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                ids, first = shared.value.encode(block)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), lists], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(kernel, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): token ids back to text; null ids give an empty text, malformed UTF-8 the replacement character."""
    small_batches(tokens.sparkSession)
    shared = _shared(tokens, vocabulary)

    def kernel(batches):
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            first = np.cumsum([0, *map(len, lists)])
            buf, at = shared.value.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), first)
            texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(kernel, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``exact``; on demand ``ids``.

    ``exact`` says that the decoded bytes are the text's own.  Null and empty
    texts have no tokens.  A text of any length is encoded whole.  Rows stay as
    they are; an empty table gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs, vocabulary)

    def kernel(batches):
        for batch in batches:
            codec = shared.value
            for block in B.blocks(batch.column(1)):
                ids, first = codec.encode(block)
                text, at = codec.decode(ids, first)
                numbers = _digests(*codec.decimal(ids, first), trim=1)
                texts = _digests(text, at)
                exact = [np.array_equal(text[a:b], block.buf[c : d - 1]) for a, b, c, d in zip(at[:-1], at[1:], block.at[:-1], block.at[1:], strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.n), pa.array(np.diff(first)), pa.array(numbers, pa.string()), pa.array(texts, pa.string()), pa.array(exact, pa.bool_()), *lists],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "exact", *["ids"] * with_ids],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(kernel, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)
