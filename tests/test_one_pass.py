"""Texts are passed over few times, and only what may be shared is named."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as queries
from quillstone.functions import md5
from quillstone.operators import contamination, grams, overlap


def test_sizes_and_shared_places_are_of_one_pass(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c d"), (3, None)], "doc_id bigint, text string")
    out = overlap.shared_windows(docs, F.split("text", " "), 3)
    # before, the result passed over all texts once more for their sizes
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 5, 3, 0, 0, 0), (2, 5, 3, 2, 2, 4), (3, 0, 0, 0, 0, 0)]


def test_first_places_where_halves_are_alike():
    row, names = np.array([0, 0, 0, 1, 1]), np.array([[5, 1], [5, 2], [5, 1], [5, 1], [5, 1]], np.uint64)
    assert overlap.first_places(row, names).tolist() == [1, 1, 0, 1, 0]
    assert overlap.first_places(row[:0], names[:0]).tolist() == []


def test_occurrences_as_counted_plainly():
    rng = np.random.default_rng(3)
    docs = [list(rng.choice(list("abc"), k)) for k in (0, 1, 4, 5, 40, 300, 2)] + [["z"] * 50]
    lists = pa.array([[], *docs], pa.list_(pa.string()))[1:]
    for n in (1, 2, 5):
        counts = [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in docs]
        want = [[sum(c.values()) for c in counts], [len(c) for c in counts], [sum(v for v in c.values() if v > 1) for c in counts]]
        assert [x.tolist() for x in grams.occurrences(*grams.words_of(lists), len(lists), n)] == want


def test_an_audit_passes_over_the_documents_once(spark, sf_dir):
    # before, the result passed over all texts for rules and for benchmark grams; now only the items are left to read
    plan = queries.queries()["D18_full_audit"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    # before, the clusters near validation took the whole audit
    assert "MapInArrow" not in queries.queries()["D10_validation_clusters"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_only_grams_that_may_be_shared_are_rows(spark):
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 20 : i * 20 + 40])) for i in range(10)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words[50:65]))], "item_id bigint, text string")
    met = contamination.met_grams(docs, "doc_id", contamination.filter_of(items, "item_id"))
    # before, each of the 280 grams was a row of the join
    assert met.count() < 40
    assert [tuple(r) for r in contamination.benchmark_hits(docs, items).collect()] == [(2, 7, 3)]


def test_heads_are_those_of_md5():
    data = np.random.default_rng(5).integers(0, 256, 4000).astype(np.uint8)
    lo = np.arange(0, 2000, 7)
    hi = lo + np.arange(len(lo)) % 130
    want = [int(hashlib.md5(data[a:b].tobytes()).hexdigest()[:8], 16) for a, b in zip(lo, hi, strict=True)]
    assert md5.heads(data, lo, hi).tolist() == want
    assert md5.heads(data[:0], lo[:0], hi[:0]).tolist() == []
