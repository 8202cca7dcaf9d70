"""Array arithmetic against plain numpy, and plans that keep a row where it is."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import catalog
from quillstone.functions import vectors as V
from quillstone.queries import rowwise

RNG = random.Random(5)
VECTORS = [[RNG.uniform(-3, 3) for _ in range(n)] for n in (64, 40, 17, 16, 1)] + [[2.0, 2.0, -1.0], [0.0] * 20, [800.0, -800.0, 799.0]]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(VECTORS)), "id int, v array<double>")


def of(df, column):
    return [r.x for r in df.select("id", column.alias("x")).orderBy("id").collect()]


def soft(v):
    e = np.exp(np.array(v) - max(v))
    return e / e.sum()


def test_softmax_ranks_and_nucleus(df):
    p = V.softmax(F.col("v"))
    for got, v in zip(of(df, p), VECTORS):
        assert np.allclose(got, soft(v))
    for got, v in zip(of(df, V.ranked(F.col("v"))), VECTORS):
        assert [r.i for r in got] == sorted(range(len(v)), key=lambda i: (-v[i], i)) and [r.x for r in got] == sorted(v, reverse=True)
    for got, v in zip(of(df, V.nucleus(p, 0.7)), VECTORS):
        kept, mass = 0, 0.0
        for x in sorted(soft(v), reverse=True):
            if mass < 0.7:
                kept, mass = kept + 1, mass + x
        assert got.kept == kept and math.isclose(got.mass, mass)
    assert of(df, V.argmax(F.col("v"))) == [int(np.argmax(v)) for v in VECTORS]


def test_states_merge_in_any_grouping(df):
    places = F.transform("v", lambda x, i: i.cast("double"))
    for width in (1, 5, 16, 100):
        got = of(df, V.merged_states(F.zip_with(V.blocks(F.col("v"), width), V.blocks(places, width), V.softmax_state)))
        assert all(math.isclose(s.o / s.l, float(soft(v) @ np.arange(len(v))), abs_tol=1e-12) and s.m == max(v) for s, v in zip(got, VECTORS))


def test_attention_quantisation_and_norms(df):
    for got, v in zip(of(df, V.causal_attention(F.col("v"))), VECTORS):
        v = np.array(v)
        assert np.allclose(got, [soft(v[i] * v[: i + 1]) @ v[: i + 1] for i in range(len(v))])
    got = of(df, V.quantised(F.col("v"), V.peak(F.col("v")) / 127, -128, 127))
    assert all(np.array_equal(q, np.rint(np.array(v) / (max(map(abs, v)) / 127)) if any(v) else [0.0] * len(v)) for q, v in zip(got, VECTORS))
    assert np.allclose(of(df, V.norm(F.col("v"))), [np.linalg.norm(v) for v in VECTORS])
    assert np.allclose(of(df, V.entropy(V.softmax(F.col("v")))), [-(soft(v) * np.log(np.maximum(soft(v), 1e-12))).sum() for v in VECTORS])


def test_empty_and_null_vectors(spark):
    df = spark.createDataFrame([(0, []), (1, None)], "id int, v array<double>")
    assert of(df, V.blocks(F.col("v"), 16)) == [[], []] and of(df, V.mean(F.col("v"))) == [None, None]
    assert of(df, V.softmax(F.col("v"))) == [[], None] and of(df, V.ranked(F.col("v"))) == [[], None]


ROW_LOCAL = ["A16_document_nats_and_bytes", "A18_perplexity", "E04_document_bits_per_byte", "W09_next_token", "A39_entropy", "A43_mergeable_softmax", "M14_rms_norm", "W13_softmax", "W15_causal_attention", "W17_nucleus", "O07_top_two_renormalised"]


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_nothing_is_exchanged(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(rowwise, "table", lambda spark, folder, t: spark.read.parquet(f"{folder}/{t}.parquet"))
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
