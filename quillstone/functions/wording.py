"""Words and counts of many texts at once, in numpy: the texts are runs of one UTF-8 buffer.

The same words as ``text.normalized_words`` of the same texts, and the same
counts as ``quality.prepared``; one pass over the bytes instead of one regular
expression for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_CODES = 0x110000
#: Bytes of text that a kernel works on at once; a longer text is still taken whole.
MOST_BYTES = 4 << 20


def _flags(codes) -> np.ndarray:
    out = np.zeros(_CODES, bool)
    out[list(codes)] = True
    return out


#: What ``\s`` is in the JVM; what it is not but ``text.BLANK`` is.
_SPACE = [*range(9, 14), 32]
_WIDE_BLANK = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANKS = _flags(_SPACE + _WIDE_BLANK)
#: By byte: whether it is white space to ``\s``, and whether it begins a longer character; and one of BLANKS.
_SPACES = np.isin(np.arange(256), _SPACE)
_LEADS = np.arange(256) >= 0xC0
_BLANK_LEADS = np.isin(np.arange(256), [chr(c).encode()[0] for c in _WIDE_BLANK if c > 127])


@lru_cache(maxsize=1)
def letters(spark: SparkSession) -> np.ndarray:
    """Whether each code point is a letter or digit to the JVM, as one bit each."""
    every = "".join(chr(c) for c in range(_CODES) if not 0xD800 <= c <= 0xDFFF)
    runs = spark.createDataFrame([(every,)], "text string").select(F.array_join(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "").alias("found"))
    return np.packbits(_flags(map(ord, runs.first().found)))


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits).view(bool)


def bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, and the last ends, in a buffer; and the buffer, with four bytes more."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(4, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], np.append(data, np.zeros(4, np.uint8))


def slices(batch: pa.RecordBatch, column: int, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many bytes of text, or of one row."""
    ends = bytes_of(batch.column(column))[0]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _marked(data: np.ndarray, flags: np.ndarray, leads: np.ndarray = _LEADS) -> np.ndarray:
    """Whether each byte is of a flagged character; ``data`` as of ``bytes_of``; ``leads`` begin all that are flagged."""
    small = np.zeros(256, bool)
    small[:128] = flags[:128]
    out = small[data]
    lead = np.flatnonzero(leads[data])
    if len(lead):
        b, c, d, e = (data[lead + k].astype(np.int64) for k in range(4))
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        c, d, e = c & 63, d & 63, e & 63
        code = np.where(size == 2, (b & 31) << 6 | c, np.where(size == 3, (b & 15) << 12 | c << 6 | d, (b & 7) << 18 | c << 12 | d << 6 | e))
        yes = flags[np.minimum(code, _CODES - 1)]
        lead, size = lead[yes], size[yes]
        for k in range(4):
            out[lead[size > k] + k] = True
    return out


def _runs(mark: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the runs of marked bytes; none goes on into the next text."""
    first, last = mark.copy(), mark.copy()
    first[1:] &= ~mark[:-1]
    last[:-1] &= ~mark[1:]
    some = ends[1:] > ends[:-1]
    at = ends[:-1][some]
    first[at] = mark[at]
    at = ends[1:][some] - 1
    last[at] = mark[at]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(ends, lo, "right") - 1, lo, hi


def words(ends: np.ndarray, data: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of every word of lower-cased texts: runs of letters and digits, with one inner apostrophe at most."""
    mark = _marked(data, flags)
    mark[ends[-1] :] = False
    row, lo, hi = _runs(mark, ends)
    link = np.zeros(len(lo), bool)
    link[1:] = (lo[1:] == hi[:-1] + 1) & (data[hi[:-1]] == ord("'")) & (row[1:] == row[:-1])
    place = np.arange(len(lo))
    # of runs in a chain, every second one belongs to the one before
    second = (place - np.maximum.accumulate(np.where(link, 0, place))) % 2 == 1
    hi[np.flatnonzero(second) - 1] = hi[second]
    return row[~second], lo[~second], hi[~second]


def joined(data: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: int) -> pa.StringArray:
    """Each row's words, joined by one space."""
    size = hi - lo
    gap = np.zeros(len(row), np.int64)
    gap[:-1] = row[1:] == row[:-1]
    end = np.cumsum(size + gap)
    before = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    out[step + np.repeat(end - gap - size - before, size)] = data[step + np.repeat(lo - before, size)]
    offsets = np.append(0, end)[np.searchsorted(row, np.arange(rows + 1))].astype(np.int32)
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out))


def _sums(mark: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mark) + 1, np.int64)
    np.cumsum(mark, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def word_chars(data: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: int) -> np.ndarray:
    """Characters of the words of each row."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data & 0xC0 != 0x80, out=total[1:])
    return np.bincount(row, total[hi] - total[lo], rows).astype(np.int64)


def counts(texts: pa.StringArray) -> dict[str, np.ndarray]:
    """Of each text: chars, wide_chars, raw_words, symbol_words, text_lines, bullets."""
    ends, data = bytes_of(texts)
    rows = len(texts)
    blank = _marked(data, BLANKS, _BLANK_LEADS)
    odd = blank & ~_SPACES[data]
    mark = ~blank
    mark[ends[-1] :] = False
    row, lo, _ = _runs(mark, ends)
    a, b, c = (data[lo + k] for k in range(3))
    dots = (a == ord(".")) & (b == ord(".")) & (c == ord(".")) & (lo + 3 <= ends[row + 1])
    symbol = (a == ord("#")) | dots | ((a == 0xE2) & (b == 0x80) & (c == 0xA6))
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, lo)
    first = np.ones(len(lo), bool)
    first[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    row1, lo1 = row[first], lo[first]
    begin = np.maximum(ends[row1], np.append(0, breaks + 1)[line[first]])
    total = np.append(0, np.cumsum(odd))
    bullet = (a == ord("-")) | (a == ord("*")) | ((a == 0xE2) & (b == 0x80) & (c == 0xA2))
    bullet = bullet[first] & (total[lo1] == total[begin])
    number = lambda of: np.bincount(of, minlength=rows).astype(np.int64)
    return {
        "chars": _sums(data & 0xC0 != 0x80, ends),
        "wide_chars": _sums(data >= 0xC0, ends),
        "raw_words": number(row),
        "symbol_words": number(row[symbol]),
        "text_lines": number(row1),
        "bullets": number(row1[bullet]),
    }
