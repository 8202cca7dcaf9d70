"""Merged moments against numpy; samples against their weights, in any partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import moments, sampling


def test_moments_merge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1000, 1, (500, 6)) @ rng.normal(0, 1, (6, 6))
    rows = [(r.tolist(),) for r in x] + [(None,), ([1.0],), ([float("nan")] * 6,), ([None] + [0.0] * 5,)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(7)
    got = moments.products(df, "v", 6).first()
    centred = x - x.mean(0)
    assert got.n == 500 and np.allclose(got.mean, x.mean(0)) and np.allclose(np.reshape(got.m2, (6, 6)), centred.T @ centred)
    a, b = centred[:, :2], centred[:, 2:]
    cka = (np.square(b.T @ a).sum()) / math.sqrt(np.square(a.T @ a).sum() * np.square(b.T @ b).sum())
    assert np.isclose(moments.linear_cka(df, "v", 6, 2).first().cka, cka)
    assert tuple(moments.linear_cka(df.where("false"), "v", 6, 2).first()) == (0, None)
    p = np.exp(x - x.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top = np.argsort(-x, axis=1, kind="stable")[:, :2]
    for r in moments.routing(df, "v", 6, 2).collect():
        assert np.isclose(r.importance, p[:, r.expert].mean()) and np.isclose(r.load, (top == r.expert).any(1).mean())


def _chi_square(counts, expected):
    return sum((c - e) ** 2 / e for c, e in zip(counts, expected, strict=True))


def test_sample_is_the_same_in_any_partitioning(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 4).alias("w"))
    picked = [sorted(r.id for r in sampling.weighted_sample(d, F.col("w"), 0.1, "s", ["id"]).collect()) for d in (df, df.repartition(13), df.orderBy(F.desc("id")).coalesce(1))]
    assert picked[0] == picked[1] == picked[2] and len(picked[0]) == 300
    # without replacement and for small shares, groups stand nearly as their weights: 1, 2, 3
    counts = [sum(i % 4 == k for i in picked[0]) for k in (1, 2, 3)]
    assert _chi_square(counts, [50, 100, 150]) < 13.8
    assert sampling.weighted_sample(df, F.col("w"), 0, "s", ["id"]).count() == 0
    assert sampling.weighted_sample(df, F.col("w"), 1, "s", ["id"]).count() == 3000
    assert sampling.weighted_sample(df.where("false"), F.col("w"), 0.5, "s", ["id"]).count() == 0


def test_a_mixture_has_its_weights(spark):
    """A source with a third of all rows and a small weight doesn't flood the sample."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "a").otherwise("b").alias("source"))
    got = {r.source: r["count"] for r in sampling.mixture(df, "source", {"hot": 0.1, "a": 0.6, "b": 0.3, "none": 9.0}, 0.05, "x", ["id"]).groupBy("source").count().collect()}
    assert sum(got.values()) == 300 and _chi_square([got["hot"], got["a"], got["b"]], [30, 180, 90]) < 13.8


def test_alias_draws_follow_their_weights(spark):
    items = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.5), ("d", 0.5), ("e", 0.0), (None, 4.0), ("f", None)], "item string, w double")
    each = spark.range(20_000)
    got = {r.item: r["count"] for r in sampling.draws(items, "item", "w", each, "id", "t").groupBy("item").count().collect()}
    assert set(got) == {"a", "b", "c", "d"} and _chi_square([got[k] for k in "abcd"], [10_000, 6000, 3000, 1000]) < 16.3
    again = sampling.draws(items, "item", "w", each.repartition(5), "id", "t")
    assert {r.item: r["count"] for r in again.groupBy("item").count().collect()} == got
    table = sampling.Alias(np.array([0.1, 0.2, 0.7]))
    grid = (np.arange(100_000) + 0.5) / 100_000
    share = np.bincount(table.draw(np.repeat(grid[::100], 100), np.tile(grid[::1000], 1000)), minlength=3) / 100_000
    assert np.allclose(share, [0.1, 0.2, 0.7], atol=0.01)
    with pytest.raises(ValueError, match="not all zero"):
        sampling.Alias(np.zeros(3))
