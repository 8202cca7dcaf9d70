"""The first 32 bits of MD5 digests of many short byte strings, in numpy: one string a lane."""

from __future__ import annotations

import hashlib
import math

import numpy as np

U32 = np.uint32
_SINES = [U32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (U32(0x67452301), U32(0xEFCDAB89), U32(0x98BADCFE), U32(0x10325476))
#: Bytes that one MD5 block holds beside its padding; and lanes at once, few enough for the cache.
SHORT, LANES = 55, 8192
#: By length: which bytes of a block are the string's; and its padding, which ends with the number of bits.
_OWN = np.where(np.arange(64) < np.arange(SHORT + 1)[:, None], 255, 0).astype(np.uint8)
_PADDING = np.where(np.arange(64) == np.arange(SHORT + 1)[:, None], 128, 0).astype(np.uint8)
_PADDING[:, 56:58] = (8 * np.arange(SHORT + 1)[:, None] >> np.array([0, 8])) & 255


def _block(words: np.ndarray) -> np.ndarray:
    """First word of the state after one block: ``words`` are 16 x lanes."""
    a, b, c, d = (np.full(words.shape[1], x, U32) for x in _START)
    for i in range(64):
        turn, g = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        f = _mix(turn, b, c, d)
        f += a
        f += words[g]
        f += _SINES[i]
        k = _TURNS[turn][i % 4]
        a, d, c, b = d, c, b, ((f << U32(k)) | (f >> U32(32 - k))) + b
    return a + _START[0]


def _mix(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if turn == 0:
        return d ^ (b & (c ^ d))
    if turn == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if turn == 2 else c ^ (b | ~d)


def blocks(data: np.ndarray, size: int) -> np.ndarray:
    """The bytes from each place on, as one item that is copied as a whole; zeros beyond the end."""
    padded = np.append(data, np.zeros(size, np.uint8))
    return np.lib.stride_tricks.as_strided(padded[:size].view(f"V{size}"), (len(data) + 1,), (1,), writeable=False)


def heads(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first eight hex digits, as a number, of the digest of each ``data[lo:hi]``."""
    out = np.empty(len(lo), U32)
    size = hi - lo
    short = np.flatnonzero(size <= SHORT)
    rows = blocks(data, 64)
    for k in range(0, len(short), LANES):
        some = short[k : k + LANES]
        raw = rows[lo[some]].view(np.uint8).reshape(-1, 64)
        raw &= _OWN[size[some]]
        raw |= _PADDING[size[some]]
        out[some] = _block(np.ascontiguousarray(raw.view("<u4").T)).byteswap()
    for i in np.flatnonzero(size > SHORT):
        out[i] = int.from_bytes(hashlib.md5(data[lo[i] : hi[i]].tobytes()).digest()[:4], "big")
    return out
