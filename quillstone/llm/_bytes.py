"""Vectorised byte-level text primitives shared by the corpus operators.

Arrow hands a worker each text column as one UTF-8 buffer plus offsets, so
words can be found, hashed and compared with numpy over whole buffers, without
making Python strings.  Work is done in blocks of at most ``BLOCK_BYTES``
(a longer single text forms a block of its own), which bounds memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 19

U64 = np.uint64


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            size = max(n + n // 8, 1 << 16)
            self.up = _powers(self.base, size)
            self.down = _powers(self.inverse, size)
            self.size = size
        return self.up[:n], self.down[:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


WORD_POWERS = _Powers(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at.astype(np.int64), raw


class Block:
    """Consecutive texts laid end to end, one separator byte after each.

    rows: slice of the batch; buf: bytes; at: where each text starts in buf
    (n + 1 entries, the last is the end).
    """

    def __init__(self, lo: int, hi: int, buf: np.ndarray, at: np.ndarray):
        self.lo, self.hi, self.buf, self.at = lo, hi, buf, at

    @property
    def n(self) -> int:
        return self.hi - self.lo


def blocks(column, separator: int = 0x20, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in blocks of at most ``limit`` bytes, or of one text."""
    offsets, raw = column_bytes(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + 4096, n)
        lengths = np.diff(offsets[lo : hi + 1])
        at = np.zeros(hi - lo + 1, np.int64)
        np.cumsum(lengths + 1, out=at[1:])
        buf = np.full(at[-1], separator, np.uint8)
        keep = np.ones(at[-1], bool)
        keep[at[1:] - 1] = False
        buf[keep] = raw[offsets[lo] : offsets[hi]]
        yield Block(lo, hi, buf, at)
        lo = hi


def word_table(separators) -> np.ndarray:
    """256 entries: True for bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words are separated by space and by 09 to 0D only.
SPACED = word_table([0x20, *range(0x09, 0x0E)])
#: Words are ASCII letters, ASCII digits and everything beyond ASCII.
ALNUM = word_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """Words of a block: start and end in buf, and first word of each text (n + 1 entries)."""

    def __init__(self, block: Block, table: np.ndarray, lower: bool = False):
        self.buf = LOWER[block.buf] if lower else block.buf
        inside = np.empty(len(self.buf) + 1, bool)
        inside[0] = False
        np.take(table, self.buf, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        # the block ends with a separator, so edges come in pairs
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, block.at)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """Number of the text, within the block, that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal hashes are a hint, callers compare bytes or digests."""
        return xxh64_spans(self.buf, self.start, self.end)


def span_hashes(names: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """64-bit hashes of ``names[start : start + length]`` for many spans at once, to find what may be equal."""
    up, down = WORD_POWERS.get(len(names) + 1)
    total = np.zeros(len(names) + 1, U64)
    np.cumsum(names * up[:-1], out=total[1:])
    h = (total[start + length] - total[start]) * down[start]
    return mix64(h ^ (np.asarray(length).astype(U64) * U64(0xE7037ED1A0B428DB)))


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """16-byte BLAKE2b digests of each ``buf[start:end]``: equal only if the bytes are."""
    view = memoryview(np.ascontiguousarray(buf))
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0]..start[0]+length[0]-1, start[1].. and so on."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    filled = length > 0
    s, n = start[filled], length[filled]
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words joined by one space each: buffer, start and end of each word in it."""
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    buf = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    if len(end):
        keep = np.ones(len(buf), bool)
        keep[end] = False
        if len(words.buf) == len(buf) and np.array_equal(words.start, start):
            buf[keep] = words.buf[keep]
        else:
            buf[keep] = words.buf[ragged(words.start, length)]
    return buf, start, end


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _xx_final(h: np.ndarray) -> np.ndarray:
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    return h


def xxh64_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``buf[start:end]``, for all spans at once.

    Spans of up to 31 bytes follow the published short-input path in numpy;
    longer ones, which three words rarely make, go to the xxhash library.
    """
    out = np.empty(len(start), U64)
    length = end - start
    long = length >= 32
    if long.any():
        view = memoryview(np.ascontiguousarray(buf))
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh64_intdigest(view[start[i] : end[i]], seed)
    rows = np.flatnonzero(~long)
    if not len(rows):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    w8 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    w4 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    # rows ordered by length, so each step works on a tail slice
    rows = rows[np.argsort(length[rows].astype(np.int8), kind="stable")]
    at, n = start[rows].copy(), length[rows].astype(np.int64)
    h = (n.astype(U64) + (U64(seed) + _P5)).astype(U64)
    with np.errstate(over="ignore"):
        for lane in range(1, 4):
            lo = int(np.searchsorted(n, 8 * lane))
            if lo == len(n):
                break
            k = w8[at[lo:]] * _P2
            k = _rotl(k, 31) * _P1
            h[lo:] = _rotl(h[lo:] ^ k, 27) * _P1 + _P4
            at[lo:] += 8
        rest = n & 7
        four = np.flatnonzero(rest >= 4)
        if len(four):
            k = w4[at[four]].astype(U64) * _P1
            h[four] = _rotl(h[four] ^ k, 23) * _P2 + _P3
            at[four] += 4
        rest &= 3
        for step in range(1, 4):
            some = np.flatnonzero(rest >= step)
            if not len(some):
                break
            k = padded[at[some]].astype(U64) * _P5
            h[some] = _rotl(h[some] ^ k, 11) * _P1
            at[some] += 1
        out[rows] = _xx_final(h)
    return out
