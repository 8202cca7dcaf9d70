"""Shared windows against comparing all windows; the filter passes all that it holds."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import bloom, overlap


def _plain(docs, n):
    first, out = {}, []
    split = [(i, (t or "").split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    for i, w in split:
        windows = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        hit = [k for k, x in enumerate(windows) if i is not None and first[x] < i]
        covered = {p for k in hit for p in range(k, k + n)}
        out.append((i, len(w), len(set(windows)), len({windows[k] for k in hit}), len(hit), len(covered)))
    return sorted(out, key=repr)


def test_as_comparing_all_windows(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choices("abcdefgh", k=80)) for _ in range(6)]
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) + " " + rng.choice(base)[rng.randint(0, 90) :]) for i in range(60)]
    docs += [(100, None), (101, ""), (None, base[0]), (102, base[0]), (102, base[1]), (102, base[1]), (103, "x " * 20_000), (104, "x " * 500 + base[2]), (0, "x " * 25)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id bigint, text string, lo int, name string").repartition(4)
    for n in (1, 4, 9, 20):
        got = overlap.shared_windows(df, F.filter(F.split("text", " "), lambda w: w != ""), n)
        assert sorted(map(tuple, got.collect()), key=repr) == _plain(docs, n)
    assert overlap.shared_windows(df.where("false"), F.split("text", " ")).count() == 0


def test_rolling_hash_is_the_polynomial():
    names = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
    got = overlap.rolling(names, 7)
    for i in range(44):
        assert int(got[i]) == sum(int(names[i + j]) * pow(overlap.BASE, j, 1 << 64) for j in range(7)) % (1 << 64)
    assert len(overlap.rolling(names[:3], 7)) == 0


def test_filter_holds_what_was_put_in(spark):
    values = spark.range(20_000).select((F.col("id") * 7919 - 10**9).alias("v"))
    made = bloom.build(values, 20_000)
    own = (np.arange(20_000) * 7919 - 10**9).astype(np.int64).view(np.uint64)
    assert made.holds(own).all() and made.holds(own + np.uint64(1)).mean() < 0.02
    assert not bloom.build(values.where("false"), 0).holds(own).any()
