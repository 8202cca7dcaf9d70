"""Weighted samples that don't depend on how rows are partitioned.

Without replacement: every row gets an exponential key of rate equal to its
weight, made from a seed and its identity; the sample is the rows of least keys.
The least keys of two tables together are among the least of each, so the
sample is a mergeable reservoir; its last key is found by rank selection, and
no task sorts the table.

With replacement: draws go through an alias table, two looks a draw whatever
the number of weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import hash32
from quillstone.operators import ranks
from quillstone.plans.store import written


def exponential_key(weight: Column, seed: str, *identity: Column) -> Column:
    """``-ln(u) / weight`` with u from 64 bits of a digest of seed and identity; null for weights that aren't above 0."""
    text = F.concat_ws("/", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in identity])
    u = (hash32(text).cast("double") + (hash32(F.concat(text, F.lit("/low"))).cast("double") + 0.5) / 2.0**32) / 2.0**32
    return F.when(weight > 0, -F.log(u) / weight)


def weighted_sample(rows: DataFrame, weight: Column, share: float, seed: str, identity: list[str]) -> DataFrame:
    """The rows of least keys: ``ceil(share * n)`` of the n rows with a weight above 0.

    Rows whose ``identity`` columns are equal share one key and so one fate, so
    that the last key may take in more than its share.  Null and other weights
    are never taken; an empty table gives no rows.
    """
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    if not share:
        return rows.where("false")
    keyed = rows.withColumn("__key", exponential_key(weight, seed, *[F.col(c) for c in identity])).where("__key is not null")
    last = ranks.values_at_ranks(keyed.select("__key"), [], "__key", {"last": f"CAST(ceil({share}D * n) AS BIGINT) - 1"}).select("last")
    bound = last.first()  # one number
    return (keyed.where("false") if bound is None else keyed.where(F.col("__key") <= F.lit(bound.last))).drop("__key")


class Alias:
    """Walker's table of weights: a draw takes a slot, and then the slot's own item or its alias."""

    def __init__(self, weights: np.ndarray):
        weights = np.asarray(weights, np.float64)
        if not len(weights) or (weights < 0).any() or not np.isfinite(weights).all() or not weights.sum() > 0:
            raise ValueError("weights are finite, not negative, and not all zero")
        n = len(weights)
        self.keep, self.alias = weights * n / weights.sum(), np.arange(n)
        small, large = [i for i in range(n) if self.keep[i] < 1], [i for i in range(n) if self.keep[i] >= 1]
        while small and large:
            i, j = small.pop(), large[-1]
            self.alias[i] = j
            self.keep[j] -= 1 - self.keep[i]
            if self.keep[j] < 1:
                small.append(large.pop())
        for i in small + large:  # what rounding leaves is whole
            self.keep[i] = 1

    def draw(self, slot: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Items for uniform numbers in [0, 1): one for the slot, one for the choice in it."""
        at = np.minimum((slot * len(self.keep)).astype(np.int64), len(self.keep) - 1)
        return np.where(u < self.keep[at], at, self.alias[at])


def draws(items: DataFrame, item_col: str, weight_col: str, each: DataFrame, id_col: str, seed: str) -> DataFrame:
    """(id, item): for every row of ``each`` one item, with replacement, by weight.

    ``items`` is the mixture's own table: small, and sent to all tasks; null
    items and weights, and weights of 0, are never drawn.  A row's draw is made
    from seed and id alone.
    """
    known = sorted((r[0], r[1]) for r in items.where(F.col(item_col).isNotNull() & (F.col(weight_col) > 0)).select(item_col, F.col(weight_col).cast("double")).collect())
    table = Alias(np.array([w for _, w in known]))
    names = pa.array([i for i, _ in known])
    shared = each.sparkSession.sparkContext.broadcast((table, names))
    kinds = {c: each.schema[id_col].dataType.simpleString() if c == "id" else items.schema[item_col].dataType.simpleString() for c in ("id", "item")}

    def kernel(batches):
        table, names = shared.value
        for batch in batches:
            slot, u = (np.asarray(batch.column(i)).astype(np.float64) / 2.0**32 for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(table.draw(slot, u)))], names=["id", "item"])

    text = F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    drawn = each.select(F.col(id_col).alias("id"), hash32(text).alias("slot"), hash32(F.concat(text, F.lit("/choice"))).alias("u"))
    return drawn.mapInArrow(kernel, f"id {kinds['id']}, item {kinds['item']}").withColumnsRenamed({"id": id_col, "item": item_col})


def mixture(docs: DataFrame, source_col: str, weights: dict[str, float], share: float, seed: str, identity: list[str]) -> DataFrame:
    """A sample of ``share`` of the rows in which sources stand as their weights say, as far as they have rows.

    A row's weight is its source's divided by the source's rows; sources without
    a weight are left out.
    """
    counts = written(docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("__n")), "sources")
    listed = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__source string, __w double")
    # the mixture's weights are a short list
    each = counts.join(F.broadcast(listed), "__source")
    joined = docs.join(each, docs[source_col] == each["__source"])
    return weighted_sample(joined, F.col("__w") / F.col("__n"), share, seed, identity).drop("__source", "__w", "__n")
