"""Rank selection and places against plain sorting."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import ranks


def _rows():
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randint(0, 3))) for _ in range(2000)] + [("c", rng.choice([1e308, -1e308, 0.0, 1e-300])) for _ in range(500)]
    rows += [("d", 10.0**k) for k in range(-300, 300)] + [("e", 5.0)] + [(None, float(i)) for i in range(700)]
    return rows + [("f", None), ("f", float("nan")), ("a", float("inf")), ("g", 1.0), ("g", None), ("g", 2.0)]


def test_quantiles_are_exact(spark):
    rows = _rows()
    df = spark.createDataFrame([(k, v, 1.0) for k, v in rows], "k string, v double, lo double").repartition(5)
    want = {}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None and np.isfinite(v)]
        if values:
            want[key] = tuple(float(np.quantile(values, p)) for p in (0.0, 0.5, 0.99, 1.0))
    at = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for few, bins in ((20_000, 512), (3, 32)):
        got = {r.k: tuple(r[name] for name in at) for r in ranks.quantiles(df, ["k"], "v", at, few, bins).collect()}
        assert set(got) == set(want)
        for key, values in want.items():
            assert np.allclose(got[key], values, rtol=1e-12, atol=0), (key, got[key], values)
    assert ranks.quantiles(df.where("false"), ["k"], "v", at).count() == 0
    whole = ranks.values_at_ranks(df.where("k = 'e'"), [], "v", {"first": "0", "beyond": "n"}).collect()
    assert [(r.n, r.first, r.beyond) for r in whole] == [(1, 5.0, None)]


def test_no_buffer_beyond_the_limit(spark):
    """A range that is ranked as a whole holds ``few`` rows at most, or one value."""
    df = spark.range(20_000).select(F.lit("x").alias("k"), (F.rand(1) ** 8).alias("v"))
    df = df.persist()
    values = sorted(r.v for r in df.collect())
    got = ranks.values_at_ranks(df, ["k"], "v", {"m": "n div 2"}, few=50, bins=32).first()
    assert got.m == values[10_000]
    df.unpersist()


def test_places_in_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = {r.i: (r.place, r.group_size) for r in ranks.places(df, ["k"], [-F.col("v"), F.col("i")], parts=13).collect()}
    for key in {k for k, _, _ in rows}:
        own = sorted(((-v, i) for k, v, i in rows if k == key))
        assert [got[i] for _, i in own] == [(p, len(own)) for p in range(1, len(own) + 1)]
    assert ranks.places(df.where("false"), ["k"], [F.col("v")]).count() == 0
