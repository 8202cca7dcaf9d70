"""Connected components of an edge table, as alternating star contractions.

Each round is two group-bys with partial aggregation and two joins, all on
node keys, so no component is ever gathered in one task or on the driver.
Rounds are separated by written tables, which survive lost executors.  In a
large graph the aggregates are written before they are joined back: a join of
two plain exchanges can split the links of a hub, one with an aggregate can't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.store import written

#: Links from which on aggregates are written; below, they are small enough for any task.
LARGE = 1_000_000
#: Links from which on nothing is broadcast: files of links are far smaller than what the driver would make of them.
MERGED = 250_000


def _met(edges: DataFrame, least: DataFrame, merged: bool) -> DataFrame:
    return edges.hint("merge").join(least.hint("merge"), "a") if merged else edges.join(least, "a")


def _large_star(edges: DataFrame, large: bool, merged: bool) -> DataFrame:
    """Every neighbour above a node is linked to the node's least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    least = written(least, "least") if large else least
    return _met(both, least, merged).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, large: bool, merged: bool) -> DataFrame:
    """Every node's lower neighbours, and the node, are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    least = written(least, "least") if large else least
    low = _met(edges, least, merged).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the least node reachable.

    Self links and repeated links change nothing.  Nodes that only have self
    links get no row.  Null ends are ignored.  An empty table gives no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "links")
    seen = None
    for _ in range(max_rounds):
        # a forest of stars (each upper node once, no root above another) is the end
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == seen or not state.n:
            break
        seen = (state.n, state.h)
        large, merged = state.n >= LARGE, state.n >= MERGED
        e = _large_star(e, large, merged)
        e = written(_small_star(written(e, "links") if large else e, large, merged), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
