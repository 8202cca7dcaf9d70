"""Arithmetic on array columns, a row at a time: no cell becomes a row, so nothing is exchanged.

Vectors are ``array<double>`` without nulls in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    """Null for an empty vector."""
    return F.try_divide(total(v), F.size(v).cast("double"))


def dot(v: Column, w: Column) -> Column:
    return total(F.zip_with(v, w, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def peak(v: Column) -> Column:
    """The greatest absolute value."""
    return F.array_max(F.transform(v, F.abs))


def softmax(v: Column) -> Column:
    """Shifted by the greatest value, so that no exponential overflows."""
    shifted = lambda m: F.transform(v, lambda x: F.exp(x - m))
    return let(F.array_max(v), lambda m: let(shifted(m), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))))


def entropy(p: Column, floor: float = 1e-12) -> Column:
    return -total(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(floor)))))


def ranked(v: Column) -> Column:
    """(i, x) by descending x, the least place of equals first."""
    keyed = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("k"), i.alias("i"))))
    return F.transform(keyed, lambda s: F.struct(s["i"].alias("i"), (-s["k"]).alias("x")))


def nucleus(p: Column, mass: float) -> Column:
    """Kept entries, and their mass, of the fewest largest that reach a mass; the one that crosses it is kept."""
    start = F.struct(F.lit(0).cast("bigint").alias("kept"), F.lit(0.0).alias("mass"))

    def step(s: Column, r: Column) -> Column:
        return F.when(s["mass"] < mass, F.struct((s["kept"] + 1).alias("kept"), (s["mass"] + r["x"]).alias("mass"))).otherwise(s)

    return F.aggregate(ranked(p), start, step)


def blocks(v: Column, width: int) -> Column:
    """Runs of so many cells; the last may be shorter, and an empty vector has none."""
    last = F.floor((F.size(v) - 1) / width).cast("int")
    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * width + 1, width))).otherwise(F.array().cast("array<array<double>>"))


def argmax(v: Column) -> Column:
    """The first place, from 0, of the greatest value."""
    return let(v, lambda u: F.array_position(u, F.array_max(u)) - 1)


def softmax_state(x: Column, value: Column) -> Column:
    """State of a block: greatest score m, sum l of exponentials, weighted sum o of values."""
    weights = lambda m: F.transform(x, lambda y: F.exp(y - m))
    return let(F.array_max(x), lambda m: let(weights(m), lambda e: F.struct(m.alias("m"), total(e).alias("l"), dot(e, value).alias("o"))))


def merged_states(states: Column) -> Column:
    """One state of several, in any grouping: each is scaled to the greater m."""
    start = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("l"), F.lit(0.0).alias("o"))

    def merge(a: Column, b: Column) -> Column:
        def at(m: Column) -> Column:
            add = lambda f: a[f] * F.exp(a["m"] - m) + b[f] * F.exp(b["m"] - m)
            return F.struct(m.alias("m"), add("l").alias("l"), add("o").alias("o"))

        return let(F.greatest(a["m"], b["m"]), at)

    return F.aggregate(states, start, merge)


def causal_attention(v: Column) -> Column:
    """Each cell as query over those up to it, which are keys and values."""

    def attend(q: Column, i: Column) -> Column:
        return let(F.slice(v, 1, i + 1), lambda k: dot(softmax(F.transform(k, lambda x: q * x)), k))

    return F.transform(v, attend)


def quantised(v: Column, scale: Column, low: int, high: int) -> Column:
    """Nearest steps of a scale, halves to even, cut off at the ends; all 0 where the scale is."""
    return F.transform(v, lambda x: F.when(scale == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.rint(x / scale)))))
