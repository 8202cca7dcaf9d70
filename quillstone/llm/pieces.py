"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback.

For every prefix of a text there is one last token that its encoding ends in,
so the encoding of all prefixes is a table of last tokens:

1. an Aho-Corasick automaton over the pieces names every piece that ends at a
   place, longest first;
2. of those, the last token is the one that is compatible with the last token
   of the prefix before it: two tokens are compatible if merging their joined
   characters gives these two tokens again;
3. the ids are read off backwards, each last token naming the prefix before it.

The table takes time in proportion to the text, however long a text without
spaces is.  A text is cut beforehand wherever no piece holds the two characters
next to each other, as no merge can cross such a place; equal parts are encoded
once.  Nothing is trained here: the model is a file whose path is a parameter.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.llm.bpe import Codec
from quillstone.plans.store import small_batches

U64 = np.uint64
#: Fixed: the mark that stands for a space inside pieces, and what the unknown id decodes to.
MARK, UNKNOWN_SURFACE = "▁", " ⁇ "
#: Fixed: kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts that are kept encoded between blocks, in each of two generations.
MEMO = 150_000
_PAIR_BITS = 22


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of one protocol-buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    at = 0
    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


class Model:
    """What a model file says: pieces with scores and kinds, and ids of the special pieces."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normal: dict = {}
        for field, value in _fields(raw):
            if field == 1:
                of = dict(_fields(value))
                self.pieces.append(of[1].decode())
                self.scores.append(struct.unpack("<f", of[2])[0] if 2 in of else 0.0)
                self.kinds.append(of.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        refused = {
            "not of the merge type": trainer.get(3, 1) != 2,
            "without byte fallback": not trainer.get(35, 0) or self.kinds.count(BYTE) != 256,
            "with a character map": bool(normal.get(2)),
            "without a space before the text": not normal.get(3, 1),
            "that drops spaces": bool(normal.get(4, 1)),
            "that leaves spaces unmarked": not normal.get(5, 1),
            "that marks spaces after words": bool(trainer.get(24, 0)),
            "with user-defined or unused pieces": USER_DEFINED in self.kinds or UNUSED in self.kinds,
        }
        if any(refused.values()):
            raise ValueError("a model " + ", ".join(k for k, v in refused.items() if v))
        at = {p: i for i, p in enumerate(self.pieces)}
        self.begin, self.end = at[trainer.get(46, b"<s>").decode()], at[trainer.get(47, b"</s>").decode()]
        self.bytes = [at[f"<0x{b:02X}>"] for b in range(256)]


class Pieces:
    """A model ready for encoding and decoding; sent to workers once.

    Tokens are numbers: ids of pieces, and numbers beyond them for characters
    that stand in pieces without being pieces themselves (encoded as bytes).
    """

    def __init__(self, model: Model):
        self.model = model
        normal = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        self.text = list(model.pieces)
        self.number = {model.pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in model.pieces[i]} - set(self.number)):
            self.number[c] = len(self.text)
            self.text.append(c)
        place = {score: r for r, score in enumerate(sorted({model.scores[i] for i in normal}, reverse=True))}
        self.rank = {i: place[model.scores[i]] for i in normal}
        shared = Counter(self.rank[i] for i in normal if len(model.pieces[i]) > 1)
        self.tied = {r for r, n in shared.items() if n > 1}
        # the two tokens that a token is made of when it is merged by itself; None if merging makes something else of it
        self.halves: dict[int, tuple[int, int] | None] = {}
        for t in sorted(self.number.values(), key=lambda t: len(self.text[t])):
            if len(self.text[t]) > 1:
                made: dict[int, tuple[int, int]] = {}
                self.halves[t] = made[t] if self.merge(self.text[t], made) == [t] else None
        steady = all(self._made_at(x) < self.rank[t] or self._made_at(x) == self.rank[t] in self.tied for t, h in self.halves.items() if h for x in h)
        if not steady:
            raise ValueError("a piece is merged before its parts")
        self.whole = [t for t in self.number.values() if len(self.text[t]) == 1 or self.halves[t]]
        self.chars = {self.text[t] for t in self.whole if len(self.text[t]) == 1}
        self.size = [len(x) for x in self.text]
        self.glued = np.zeros(1 << _PAIR_BITS, bool)
        pairs = {(ord(a), ord(b)) for i in normal for a, b in zip(self.text[i], self.text[i][1:], strict=False)}
        if pairs:
            a, b = np.array(sorted(pairs), np.uint32).T
            self.glued[self._pair_slot(a, b)] = True
        out = []
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            surface = {CONTROL: "", UNKNOWN: UNKNOWN_SURFACE}.get(k, p.replace(MARK, " "))
            out.append(bytes([model.bytes.index(i)]) if k == BYTE else surface.encode())
        size = np.array([len(x) for x in out], np.int64)
        self.blob, self.end = np.frombuffer(b"".join(out), np.uint8), np.cumsum(size)
        self.start = self.end - size
        self.is_byte = np.array([k == BYTE for k in model.kinds])
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(model.pieces, model.kinds, strict=True)])
        self._fresh()

    def _fresh(self) -> None:
        self.automaton = None
        self.fit: dict[int, bool] = {}
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "fit", "young", "old")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._fresh()

    @staticmethod
    def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A slot of two neighbouring characters; pairs that share one only leave a text uncut."""
        return (((a.astype(U64) << U64(21) | b.astype(U64)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - _PAIR_BITS)).astype(np.int64)

    def _made_at(self, t: int) -> int:
        """When a token is merged; characters are there from the start."""
        return self.rank[t] if len(self.text[t]) > 1 else -1

    def merge(self, text: str, made: dict[int, tuple[int, int]] | None = None) -> list[int]:
        """Tokens of a text by merging as such: the best score first, the leftmost of equals.  All its characters must be tokens."""
        tokens: list[int | None] = [self.number[c] for c in text]
        right, left = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(tokens):
                t = self.number.get(self.text[tokens[i]] + self.text[tokens[j]])
                if t is not None:
                    heapq.heappush(heap, (self.rank[t], i, tokens[i], tokens[j], t))

        for i in range(len(tokens)):
            offer(i)
        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = right[i]
            if tokens[i] != a or j >= len(tokens) or tokens[j] != b:
                continue  # one side has changed since
            if made is not None:
                made[t] = (a, b)
            tokens[i], tokens[j] = t, None
            right[i] = right[j]
            if right[i] < len(tokens):
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [t for t in tokens if t is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the characters of ``a`` and then ``b``, merged, are ``a`` and ``b`` again.

        Until a and b are whole, the last symbol of a's side and the first of
        b's are tokens on the inner edges of their trees.  Each pair of them that
        is there at one time must not merge before either becomes part of more.
        """
        x, y = a, b
        # when each side's present symbol becomes part of the next
        x_until = y_until = len(self.rank)
        while True:
            t = self.number.get(self.text[x] + self.text[y])
            x_made, y_made = self._made_at(x), self._made_at(y)
            if self.tied and not self.tied.isdisjoint((x_made, y_made, -1 if t is None else self.rank[t])):
                return self.merge(self.text[a] + self.text[b]) == [a, b]  # where scores are shared, places decide
            # of equal merges the leftmost comes first: the one that x is part of, but not the one that y is part of
            if t is not None and self.rank[t] < x_until and self.rank[t] <= y_until:
                return False
            if x_made < 0 and y_made < 0:
                return True
            if x_made >= y_made:  # of one and the same merge on both sides, the left was first: y was still in parts
                if x_made == y_made:
                    y_until, y = y_made, self.halves[y][0]
                else:
                    x_until, x = x_made, self.halves[x][1]
            else:
                y_until, y = y_made, self.halves[y][0]

    def _automaton(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for t in self.whole:
                self.automaton.add_word(self.text[t], t)
            self.automaton.make_automaton()
        return self.automaton

    def part(self, text: str) -> list[int]:
        """Ids of one part of a marked text, by the table of last tokens."""
        last = [-1] * len(text)
        fit, most, size = self.fit, len(self.text), self.size
        for at, t in self._automaton().iter(text):
            if last[at] >= 0:
                continue
            p = last[at - size[t]] if at >= size[t] else -1
            if p >= 0:  # else the text's start, or an unknown character, which merges with nothing
                key = p * most + t
                try:
                    ok = fit[key]
                except KeyError:
                    ok = fit[key] = self.compatible(p, t)
                if not ok:
                    continue
            last[at] = t
        ids, at, ends = [], len(text) - 1, len(self.model.pieces)
        while at >= 0:
            t = last[at]
            if 0 <= t < ends:
                ids.append(t)
                at -= size[t]
                continue
            if t < 0 and text[at] in self.chars:
                raise RuntimeError("no last token at a known character")
            ids += [self.model.bytes[b] for b in reversed(text[at].encode())]
            at -= 1
        ids.reverse()
        return ids

    def _remembered(self, parts: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of every part; short ones are remembered."""
        out = list(map(self.young.get, parts))
        for i, ids in enumerate(out):
            if ids is None:
                part = parts[i]
                ids = self.old.get(part)
                if ids is None:
                    ids = tuple(self.part(part.decode().replace(" ", MARK)))
                out[i] = ids
                if len(part) <= 64:
                    self.young[part] = ids
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        if len(self.fit) > 2_000_000:
            self.fit = {}
        return out

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, without begin and end, and where each text's start (n + 1 entries)."""
        # one separator more at the front: what stands before a text is its first space
        led = B.Block(block.lo, block.hi, np.concatenate([np.full(1, 0x20, np.uint8), block.buf]), block.at + 1)
        buf = led.buf
        heads = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4").copy()
        points[points == 0x20] = ord(MARK)
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.glued[self._pair_slot(points[:-1], points[1:])]
        first = (block.at[:-1] if len(heads) == len(buf) else np.searchsorted(heads, block.at[:-1])).astype(np.int64)
        cut[first] = True
        cut[-1] = True  # the last text's separator is no part of it
        begin = heads[np.flatnonzero(cut)]
        start, end = begin[:-1], begin[1:]
        full = np.diff(block.at) > 1
        owner = np.searchsorted(block.at, start, "right") - 1
        keep = full[owner]
        start, end, owner = start[keep], end[keep], owner[keep]
        where = np.zeros(block.n + 1, np.int64)
        if not len(start):
            return np.zeros(0, np.int64), where
        hashes, model, code = np.unique(B.xxh64_spans(buf, start, end), return_index=True, return_inverse=True)
        unlike = Codec._unlike(led, start, end, model[code])
        if len(unlike):  # parts that only share a hash stand for themselves
            code[unlike] = len(model) + np.arange(len(unlike))
            model = np.append(model, unlike)
        raw = buf.tobytes()
        made = self._remembered([raw[a:b] for a, b in zip(start[model].tolist(), end[model].tolist(), strict=True)])
        count = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.int64, int(count.sum()))
        at = np.cumsum(count) - count
        per = count[code]
        ids = flat[B.ragged(at[code], per)]
        where[1:] = np.cumsum(np.bincount(owner, per, block.n)).astype(np.int64)
        return ids, where

    def framed(self, ids: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with a begin and an end id around every text."""
        n = len(where) - 1
        out_at = where + 2 * np.arange(n + 1)
        out = np.empty(int(out_at[-1]), np.int64)
        inside = np.ones(len(out), bool)
        inside[out_at[:-1]] = inside[out_at[1:] - 1] = False
        out[inside] = ids
        out[out_at[:-1]], out[out_at[1:] - 1] = self.model.begin, self.model.end
        return out, out_at

    def decode(self, ids: np.ndarray, where: np.ndarray) -> list[bytes]:
        """UTF-8 of every text.

        Control pieces are nothing; the first space of a text goes if it starts
        with a piece that has one; byte pieces that aren't UTF-8 become one
        replacement character each.
        """
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.start)):
            raise ValueError("an id beyond the model")
        size = self.end[ids] - self.start[ids]
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        raw = self.blob[B.ragged(self.start[ids], size)].tobytes()
        seen = np.flatnonzero(size > 0)
        # control pieces inside a text part byte pieces that would else be read together
        gaps = np.cumsum(np.append(0, size == 0))
        first = seen[np.minimum(np.searchsorted(seen, where[:-1]), len(seen) - 1)] if len(seen) else None
        out = []
        for i, (a, b) in enumerate(zip(where[:-1].tolist(), where[1:].tolist(), strict=True)):
            lo, hi = int(at[a]), int(at[b])
            if lo < hi and self.marked[ids[first[i]]]:
                lo += 1
            text = raw[lo:hi]
            try:
                text.decode()
                whole = b - a < 4 or gaps[b - 1] == gaps[a + 1]
            except UnicodeDecodeError:
                whole = False
            if not whole:
                text = self._mended(ids[a:b], lo - int(at[a]))
            out.append(text)
        return out

    def _mended(self, ids: np.ndarray, skip: int) -> bytes:
        parts, run = [], bytearray()
        for i in ids.tolist():
            piece = self.blob[self.start[i] : self.end[i]].tobytes()
            if self.is_byte[i]:
                run += piece
                continue
            parts.append(bytes(run).decode("utf-8", "quillstone-each"))
            parts.append(piece.decode())
            run.clear()
        parts.append(bytes(run).decode("utf-8", "quillstone-each"))
        return "".join(parts)[skip:].encode()


def _each(error):
    return "�", error.start + 1


codecs.register_error("quillstone-each", _each)


def read_model(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


def _shared(df: DataFrame, model: str):
    """The model, a file on the driver, as a broadcast; it has some 32,000 pieces whatever the data."""
    return df.sparkSession.sparkContext.broadcast(Pieces(read_model(model)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", framed: bool = True) -> DataFrame:
    """(id, ids): ids of every text, with begin and end ids if ``framed``.

    Null and empty texts have no others.  A text of any length is encoded whole,
    in time and memory in proportion to it.  Rows stay as they are, repeated or
    not; an empty table gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs, model)

    def kernel(batches):
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                ids, where = shared.value.encode(block)
                if framed:
                    ids, where = shared.value.framed(ids, where)
                lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), lists], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(kernel, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): ids back to text; null ids give an empty text, ids beyond the model an error."""
    small_batches(tokens.sparkSession)
    shared = _shared(tokens, model)

    def kernel(batches):
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            where = np.cumsum([0, *map(len, lists)])
            texts = shared.value.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), where)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(kernel, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, ``n_tokens`` (begin and end included), ``ids_sha256``, ``decoded_sha256`` and ``exact``.

    Ids are digested as little-endian unsigned 32-bit integers; ``exact`` says
    that the decoded text is the text's own.  Null and empty texts have only
    their begin and end.  Texts of any length are taken whole; rows stay as they
    are; an empty table gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs, model)

    def kernel(batches):
        for batch in batches:
            pieces = shared.value
            for block in B.blocks(batch.column(1)):
                ids, where = pieces.framed(*pieces.encode(block))
                wide, view = memoryview(ids.astype("<u4")).cast("B"), memoryview(block.buf)
                numbers = [hashlib.sha256(wide[4 * a : 4 * b]).hexdigest() for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
                texts = pieces.decode(ids, where)
                exact = [t == view[a : b - 1] for t, a, b in zip(texts, block.at[:-1].tolist(), block.at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.n), pa.array(np.diff(where)), pa.array(numbers, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(exact, pa.bool_())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(kernel, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean").withColumnRenamed("id", id_col)
