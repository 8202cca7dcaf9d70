"""Word grams as 128-bit names, made in Arrow batches.

Words come from the JVM as arrays, or are runs of bytes.  A word's name is its
own bytes, mixed, or the BLAKE2b digest of a long one; a gram's name mixes its
words' names in order.  So equal grams have equal names in any task, and unlike
ones differ but by chance of 2**-128.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from quillstone.functions import md5
from quillstone.plans.store import small_batches

U64 = np.uint64
_ODD = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


#: Bytes of a word that are taken as they are; a longer one is digested.
PLAIN = 15
_OWN = np.where(np.arange(16) < np.arange(PLAIN + 1)[:, None], 255, 0).astype(np.uint8)


def names_of(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the name of each word ``data[lo:hi]`` (words x 2).

    A short word and its length are 16 bytes, which four invertible rounds mix: no two short words have one name.
    """
    if not len(lo):
        return np.zeros((0, 2), U64)
    size = hi - lo
    raw = md5.blocks(data, 16)[lo].view(np.uint8).reshape(-1, 16)
    raw &= _OWN[np.minimum(size, PLAIN)]
    raw[:, PLAIN] = np.minimum(size, PLAIN)
    out = np.ascontiguousarray(raw.view("<u8").T)
    for i in range(4):
        out[i % 2] += mixed(mixed(out[1 - i % 2] + _ODD[i % 2]) * _ODD[1])
    out = np.ascontiguousarray(out.T)
    known: dict[bytes, np.ndarray] = {}
    for i in np.flatnonzero(size > PLAIN):
        word = data[lo[i] : hi[i]].tobytes()
        if word not in known:
            known[word] = np.frombuffer(hashlib.blake2b(word, digest_size=16).digest(), "<u8")
        out[i] = known[word]
    return out


def word_names(words: pa.Array) -> np.ndarray:
    """Names of an array of words, as ``names_of`` has them."""
    if not len(words):
        return np.zeros((0, 2), U64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return names_of(np.frombuffer(words.buffers()[2] or b"", np.uint8), ends[:-1], ends[1:])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(27))


#: Fixed: the odd base of the rolling hash.
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(names: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all runs of n names, by prefix sums."""
    if len(names) < n:
        return np.zeros(0, U64)
    total = np.zeros(len(names) + 1, U64)
    np.cumsum(names * _powers(BASE, len(names)), out=total[1:])
    return (total[n:] - total[:-n]) * _powers(pow(BASE, -1, 1 << 64), len(names) - n + 1)


def words_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and name of every word."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return np.repeat(np.arange(len(lists)), np.diff(offsets)), word_names(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))


def names_at(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of the runs of n words that begin at some places, as ``gram_names`` has them."""
    out = np.zeros((len(at), 2), U64)
    for j in range(n):
        for half in (0, 1):
            out[:, half] = mixed(out[:, half] * _ODD[half] + words[at + j, half])
    return out


def occurrences(row: np.ndarray, words: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, the number of its grams, of different ones, and of those that stand in it twice or more.

    A rolling hash, sorted, tells which grams are alone in their row; only the others are named and compared.
    """
    if len(words) < n:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    at = np.flatnonzero(row[: len(words) - n + 1] == row[n - 1 :])
    total = np.bincount(row[at], minlength=rows)
    key = rolling(words[:, 0], n)[at] ^ (row[at].astype(U64) * _ODD[1])
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    np.equal(key[1:], key[:-1], out=same[1:-1])
    some = np.sort(at[order[same[1:] | same[:-1]]])
    sub, _, fresh = _sorted(row[some], names_at(words, some, n))
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(sub)))
    again = np.bincount(sub[first], np.where(size > 1, size, 0), rows)
    different = total - np.bincount(sub[~fresh], minlength=rows)
    return total.astype(np.int64), different.astype(np.int64), again.astype(np.int64)


def gram_names(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and name (two words) of every run of n words in a row; repeats included."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    words = word_names(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros((0, 2), U64)
    count = len(words) - n + 1
    whole = row[:count] == row[n - 1 :]
    out = np.zeros((count, 2), U64)
    for j in range(n):
        for half in (0, 1):
            out[:, half] = mixed(out[:, half] * _ODD[half] + words[j : j + count, half])
    return row[:count][whole], out[whole]


def _sorted(row: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and names in order, and which are the first of equals."""
    order = np.lexsort((names[:, 1], names[:, 0], row))
    row, names = row[order], names[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (names[1:] != names[:-1]).any(axis=1)
    return row, names, fresh


def binary(names: np.ndarray) -> pa.Array:
    """Names as 16 bytes each."""
    at = np.arange(len(names) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(names).tobytes())])


def names_in(column: pa.Array) -> np.ndarray:
    """The names that ``binary`` has put into an array."""
    at = 2 * np.frombuffer(column.buffers()[1], np.int32)[column.offset].astype(np.int64) // 16 if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", "<u8")[at : at + 2 * len(column)].reshape(-1, 2).copy()


def distinct_grams(lists: pa.ListArray, n: int) -> tuple[np.ndarray, pa.Array]:
    """Row number and 16-byte name of the distinct grams of each row."""
    row, names, fresh = _sorted(*gram_names(lists, n))
    return row[fresh], binary(names[fresh])


def repetition(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the number of its grams, and of those that stand in it twice or more."""
    total, _, again = occurrences(*words_of(lists), len(lists), n)
    return total, again


def counts_by_id(docs, words, n: int, id_col: str = "doc_id"):
    """(id, grams, different, repeated): occurrences of n-word grams, different ones, and occurrences of those that stand twice or more.

    One row a row, without a shuffle: for ids that no two rows share.
    """

    def kernel(batches):
        for batch in batches:
            total, different, again = occurrences(*words_of(batch.column(1)), batch.num_rows, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(different), pa.array(again)], names=["id", "grams", "different", "repeated"])

    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    return docs.select(id_col, words.alias("w")).mapInArrow(kernel, f"id {kind}, grams bigint, different bigint, repeated bigint").withColumnRenamed("id", id_col)
