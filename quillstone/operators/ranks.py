"""Exact values at ranks, and places inside groups, without a group in one task.

Rank selection: of a large group a histogram of the value range is counted,
only the bins that hold a wanted rank are kept, and those are counted again in
finer bins, until a bin holds few rows or one value.  Each round is one grouped
count whose result is bounded by bins, groups and wanted ranks.  Groups of few
rows are ranked as they are.

Places: a whole group is cut into ranges of its order first; rows are numbered
inside their range, and each range is offset by the sizes of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.plans.store import written

#: Bins of one round, and rows that may be ranked together.
BINS, FEW = 512, 20_000


def values_at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, str], few: int = FEW, bins: int = BINS) -> DataFrame:
    """One row a group: ``by``, ``n``, and for each name the value at that rank (from 0) in ascending order.

    ``ranks`` maps names to SQL over ``n``, the group's rows; a rank outside 0 to
    n - 1 gives null.  Null, NaN and infinite values are left out; a group of
    such only has no row.  Groups with a null key are groups like others; ties
    and repeated rows count each; an empty table gives no rows.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    kept = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v) and abs(__v) < double('infinity')")
    kept = kept.withColumn("__g", F.struct(*keys) if keys else F.struct(F.lit(0).alias("one")))
    groups = written(kept.groupBy("__g").agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")), "groups")
    wanted = groups.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(f"CAST({of} AS BIGINT)").alias("rank")) for name, of in ranks.items()])).alias("w"))
    wanted = wanted.select("__g", "n", "lo", "hi", "w.name", "w.rank").where("rank >= 0 and rank < n")
    # the search's state: a range of values that holds ``rank``, with ``below`` rows under it and ``inside`` in it
    state = written(wanted.select("__g", "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside")).distinct(), "ranges")
    found = []
    for _ in range(60):
        done = state.where((F.col("lo") == F.col("hi")) | (F.col("inside") <= few))
        found.append(done)
        state = state.where((F.col("lo") < F.col("hi")) & (F.col("inside") > few))
        if state.isEmpty():
            break
        state = written(_narrower(kept, state, bins), "ranges")
    else:
        raise RuntimeError("ranks did not settle")
    settled = found[0]
    for more in found[1:]:
        settled = settled.unionByName(more)
    settled = written(settled, "settled")
    plain = settled.where("lo = hi").select("__g", "rank", F.col("lo").alias("value"))
    # what is left: few rows a range, of which the one at the rank is picked
    near = settled.where("lo < hi")
    spans = near.select(F.col("__g").alias("g"), "lo", "hi").distinct()
    # equal keys by null-safe comparison, so that null groups are found too
    inside = kept.join(spans, F.col("__g").eqNullSafe(F.col("g"))).where("__v between lo and hi")
    sorted_ = inside.groupBy("g", F.col("lo").alias("l"), F.col("hi").alias("h")).agg(F.sort_array(F.collect_list("__v")).alias("vs"))
    picked = near.join(sorted_, F.col("g").eqNullSafe(F.col("__g")) & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h")))
    picked = picked.select("__g", "rank", F.expr("vs[CAST(rank - below AS INT)]").alias("value"))
    values = plain.unionByName(picked.select("__g", "rank", "value"))
    asked = wanted.select(F.col("__g").alias("a"), "name", F.col("rank").alias("r"))
    named = asked.join(values, F.col("a").eqNullSafe(F.col("__g")) & (F.col("r") == F.col("rank"))).select(F.col("a"), "name", "value")
    wide = named.groupBy("a").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks])
    out = groups.join(wide, F.col("__g").eqNullSafe(F.col("a")), "left")
    return out.select(*[F.col(f"__g.{k}").alias(c) for c, k in zip(by, keys, strict=True)], "n", *ranks)


def _narrower(kept: DataFrame, state: DataFrame, bins: int) -> DataFrame:
    """The ranges of one round, each cut to the bin that holds its rank."""
    spans = state.select(F.col("__g").alias("g"), "lo", "hi").distinct()
    # ranges of unlike magnitudes are cut by magnitude, so that few rounds narrow any of them; halves keep the widest finite
    size = "signum({0}) * IF({0} = 0, 0D, ln(abs({0})) + 800D)".format
    part = "(({0}) - ({1})) / (({2}) - ({1}))".format
    wide = "(lo < 0 AND hi > 0) OR greatest(abs(lo), abs(hi)) > 2 * least(abs(lo), abs(hi))"
    bin_ = F.expr(f"CAST(least({bins - 1}, floor({bins} * IF({wide}, {part(size('__v'), size('lo'), size('hi'))}, {part('__v / 2', 'lo / 2', 'hi / 2')}))) AS INT)")
    counted = kept.join(spans, F.col("__g").eqNullSafe(F.col("g"))).where("__v between lo and hi")
    counted = counted.groupBy("g", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("inside"), F.min("__v").alias("least"), F.max("__v").alias("most"))
    # of each range some hundred bins: an array of its sizes
    cell = F.struct("bin", "inside", "least", "most")
    arrays = counted.groupBy("g", "lo", "hi").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    joined = state.join(arrays.select(F.col("g"), F.col("lo").alias("l"), F.col("hi").alias("h"), "cells"), F.col("__g").eqNullSafe(F.col("g")) & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h")))
    # walk the bins: the first whose end lies beyond the rank
    walk = "aggregate(cells, named_struct('below', below, 'inside', 0L, 'lo', lo, 'hi', hi, 'met', false), (s, c) -> IF(s.met, s, IF(s.below + c.inside > rank, named_struct('below', s.below, 'inside', c.inside, 'lo', c.least, 'hi', c.most, 'met', true), named_struct('below', s.below + c.inside, 'inside', 0L, 'lo', s.lo, 'hi', s.hi, 'met', false))))"
    return joined.select("__g", "rank", F.expr(walk).alias("s")).select("__g", "rank", "s.lo", "s.hi", "s.below", "s.inside")


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], few: int = FEW, bins: int = BINS) -> DataFrame:
    """``by`` and, for each name, the value at that share of the group, interpolated between ranks; exact."""
    ranks: dict[str, str] = {}
    for name, p in at.items():
        if not 0 <= p <= 1:
            raise ValueError("shares lie between 0 and 1")
        ranks[f"{name}__lo"] = f"floor({p}D * (n - 1))"
        ranks[f"{name}__hi"] = f"least(floor({p}D * (n - 1)) + 1, n - 1)"
    found = values_at_ranks(rows, by, value, ranks, few, bins)
    between = [F.expr(f"{name}__lo + ({name}__hi - {name}__lo) * ({p}D * (n - 1) - floor({p}D * (n - 1)))").alias(name) for name, p in at.items()]
    return found.select(*by, *between)


def places(rows: DataFrame, by: list[str], order: list[Column], parts: int = 64) -> DataFrame:
    """``rows`` with ``place``, from 1, in its group, and ``group_size``.

    Rows are range-partitioned by group and order, so a large group spreads over
    many ranges; what is numbered together is one range's rows of one group.
    ``order`` are values, ascending, without ties inside a group; null keys and values are ordered
    as Spark does.  An empty table gives no rows.
    """
    names = [f"__o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[o.alias(n) for o, n in zip(order, names, strict=True)])
    # written: the number of a row's range is then fixed
    cut = written(keyed.repartitionByRange(parts, *by, *names).withColumn("__part", F.spark_partition_id()), "ranges")
    keys = [F.col(c) for c in by]
    sizes = cut.groupBy(*by, "__part").agg(F.count("*").alias("__size"))
    # a group has as many rows here as ranges
    totals = sizes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__part", "__size"))).alias("__cells"), F.sum("__size").alias("group_size"))
    totals = totals.select(F.struct(*keys).alias("__g"), "__cells", "group_size")
    inner = F.expr(f"row_number() OVER (PARTITION BY {', '.join([*(f'`{c}`' for c in by), '__part'])} ORDER BY {', '.join(names)})")
    numbered = cut.withColumn("__inner", inner)
    joined = numbered.join(totals, F.struct(*keys).eqNullSafe(F.col("__g")))
    before = "aggregate(filter(__cells, c -> c.__part < __part), 0L, (s, c) -> s + c.__size)"
    return joined.withColumn("place", F.expr(f"{before} + __inner").cast("bigint")).select(*rows.columns, "place", "group_size")
