"""A blocked Bloom filter of 64-bit values: built by tasks, of bounded size, asked in numpy batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
#: Bits for a value, bits of a block, bits that a value sets, and bytes of a filter at most; past that it only passes more.
VALUE_BITS, BLOCK_BITS, PROBES, MOST_BYTES = 16, 512, 6, 32 << 20
_CHUNK = 1 << 16


def _places(values: np.ndarray, blocks: int) -> np.ndarray:
    """(values, PROBES): the bits of each value, all in one block."""
    with np.errstate(over="ignore"):
        h = (values ^ (values >> U64(29))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(32))) * U64(0x94D049BB133111EB)
        block = ((h >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)
        low, step = h & U64(0xFFFF), ((h >> U64(16)) & U64(0xFFFF)) | U64(1)
        inside = (low[:, None] + step[:, None] * np.arange(PROBES, dtype=U64)) % U64(BLOCK_BITS)
    return block[:, None] * BLOCK_BITS + inside.astype(np.int64)


class Bloom:
    def __init__(self, bits: np.ndarray, blocks: int):
        self.bits, self.blocks = bits, blocks

    def holds(self, values: np.ndarray) -> np.ndarray:
        """False only for values that were not put in."""
        at = _places(values, self.blocks)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def build(values: DataFrame, count: int) -> Bloom:
    """The filter of a table's one bigint column; tasks set bits, equal chunks are merged by Spark, the driver lays them in place."""
    blocks = max(1, min(-(-count * VALUE_BITS // BLOCK_BITS), MOST_BYTES * 8 // BLOCK_BITS))
    size = blocks * BLOCK_BITS // 8

    def partial(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = _places(np.asarray(batch.column(0)).view(U64), blocks).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for lo in range(0, size, _CHUNK):
            if bits[lo : lo + _CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([bits[lo : lo + _CHUNK].tobytes()], pa.binary())], names=["lo", "bits"])

    def merged(key, frame):
        import pandas as pd

        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in frame["bits"]])
        return pd.DataFrame({"lo": [key[0]], "bits": [whole.tobytes()]})

    out = np.zeros(size, np.uint8)
    for row in values.mapInArrow(partial, "lo bigint, bits binary").groupBy("lo").applyInPandas(merged, "lo bigint, bits binary").toLocalIterator():  # MOST_BYTES at most
        out[row.lo : row.lo + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return Bloom(out, blocks)
