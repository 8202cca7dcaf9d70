"""Moments of vectors in one pass: counts, means and centred products that merge.

A task sums its vectors to one state (count, mean, products about the mean) and
sends that; states merge by the rule for two samples, in two levels, so nothing
but some states of fixed size is ever exchanged, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.store import small_batches

#: Groups that task states are merged in before they meet.
FIRST_MERGES = 64
STATE = "n bigint, mean array<double>, m2 array<double>"


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    """The column's vectors of ``dims`` finite numbers; others are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    cells = np.asarray(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    good = (np.diff(offsets) == dims) & ~np.asarray(column.is_null())
    out = cells[offsets[:-1][good][:, None] + np.arange(dims)] if good.any() else np.zeros((0, dims))
    return out[np.isfinite(out).all(axis=1)]


def merged(a: tuple, b: tuple) -> tuple:
    """The state of two samples together."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _state(x: np.ndarray) -> tuple:
    mean = x.mean(axis=0)
    centred = x - mean
    return len(x), mean, centred.T @ centred


def products(vectors: DataFrame, vector_col: str, dims: int) -> DataFrame:
    """One row (n, mean, m2): number, mean and flattened products about the mean of all vectors of ``dims`` finite numbers.

    Vectors that are null, of another length or not finite are left out; repeated
    rows count each; of an empty table n is 0 and the others are zeros.
    """
    small_batches(vectors.sparkSession, 10_000)
    zero = (0, np.zeros(dims), np.zeros((dims, dims)))

    def summed(batches):
        state = zero
        for batch in batches:
            x = vectors_of(batch.column(0), dims)
            if len(x):
                state = merged(state, _state(x))
        if state[0]:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]]), pa.array([state[1].tolist()]), pa.array([state[2].ravel().tolist()])], names=["n", "mean", "m2"])

    def together(frame):
        import pandas as pd

        state = zero
        for n, mean, m2 in zip(frame["n"], frame["mean"], frame["m2"], strict=True):
            state = merged(state, (int(n), np.array(mean), np.array(m2).reshape(dims, dims)))
        return pd.DataFrame({"n": [state[0]], "mean": [state[1].tolist()], "m2": [state[2].ravel().tolist()]})

    states = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(summed, STATE)
    # one state a task; then one a group of tasks
    few = states.groupBy(F.pmod(F.spark_partition_id(), F.lit(FIRST_MERGES)).alias("k")).applyInPandas(together, STATE)
    empty = vectors.sparkSession.createDataFrame([(0, [0.0] * dims, [0.0] * dims * dims)], STATE)
    return few.unionByName(empty).groupBy(F.lit(0).alias("k")).applyInPandas(together, STATE)


def linear_cka(vectors: DataFrame, vector_col: str, dims: int, split: int) -> DataFrame:
    """One row (n, cka): linear centred kernel alignment of the first ``split`` dimensions with the rest; null if either is constant."""
    at = f"m2[(i * {dims}) + j]"

    def square(i: str, j: str) -> str:
        return f"aggregate({i}, 0D, (s, i) -> s + aggregate({j}, 0D, (t, j) -> t + {at} * {at}))"

    a, b = f"sequence(0, {split - 1})", f"sequence({split}, {dims - 1})"
    cross, own, other = square(a, b), square(a, a), square(b, b)
    return products(vectors, vector_col, dims).select("n", F.expr(f"({cross}) / nullif(sqrt(({own}) * ({other})), 0D)").alias("cka"))


def routing(vectors: DataFrame, vector_col: str, dims: int, top: int) -> DataFrame:
    """(expert, importance, load): of each dimension, its mean softmax share and the share of vectors that have it among their ``top`` (of equals the first).

    One pass; a task sends a row a dimension.  Vectors are left out as in ``products``.
    """
    small_batches(vectors.sparkSession, 10_000)

    def summed(batches):
        n, share, chosen = 0, np.zeros(dims), np.zeros(dims, np.int64)
        for batch in batches:
            x = vectors_of(batch.column(0), dims)
            if not len(x):
                continue
            p = np.exp(x - x.max(axis=1, keepdims=True))
            share += (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
            chosen += np.bincount(np.argsort(-x, axis=1, kind="stable")[:, :top].ravel(), minlength=dims)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(share), pa.array(chosen), pa.array(np.full(dims, n))], names=["expert", "share", "chosen", "n"])

    sums = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(summed, "expert bigint, share double, chosen bigint, n bigint")
    return sums.groupBy("expert").agg((F.sum("share") / F.sum("n")).alias("importance"), (F.sum("chosen") / F.sum("n")).alias("load"))
