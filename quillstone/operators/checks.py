"""Checks inside the plan: a job that meets a row it must not have stops and names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(keys: list[str]) -> Column:
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys]
    return F.concat_ws(", ", *parts)


def constrained(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """``rows`` as they are; a row for which a rule isn't true ends the job with the rules it breaks and its keys.

    A rule that is null is broken.  The check is a filter that all rows pass, so
    it runs wherever the rows do, also when no column of a rule is used later.
    An empty table passes.
    """
    if not rules:
        return rows
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    stop = F.raise_error(F.concat(F.lit("broken: "), F.array_join(broken, ", "), F.lit(" at "), _named(keys))).cast("boolean")
    return rows.where(F.when(F.size(broken) == 0, F.lit(True)).otherwise(stop))


def failures(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, broken): the rows that ``constrained`` would stop at, with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select(*keys, broken.alias("broken")).where(F.size("broken") > 0)


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) with n = 1 for every key; a repeated key ends the job with its values."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return constrained(counted, {"one row a key": F.col("n") == 1}, keys)


def self_pivot(rows: DataFrame, keys: list[str], side: str, sides: list[str], value: str) -> DataFrame:
    """One row a key: ``keys`` and a column for each of ``sides`` with its value.

    Every key must have each side once: a missing or repeated cell, or a side
    that isn't listed, ends the job with the key and the side.  One grouped
    count, no join; a key has as many cells as there are sides.
    """
    cells = []
    for s in sides:
        own = F.col(side) == s
        cells += [F.count_if(own).alias(f"__n_{s}"), F.max(F.when(own, F.col(value))).alias(s)]
    other = F.count_if(~F.coalesce(F.col(side).isin(sides), F.lit(False))).alias("__other")
    grouped = rows.groupBy(*keys).agg(*cells, other)
    rules = {f"{s} once": F.col(f"__n_{s}") == 1 for s in sides} | {"no other side": F.col("__other") == 0}
    return constrained(grouped, rules, keys).select(*keys, *sides)
