"""Signatures in one pass are those of shingle sets, and are made once a query."""

import random

from quillstone.operators import dedup
from quillstone.queries.inventory import R


def test_signed_equals_signatures_of_sets(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "Béta", "it's", "x", "日本", "7"], k=k)) for k in (1, 3, 4, 5, 6, 40, 3000)] + ["", None, " a, b. c! d? ", "one two three four five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {r.doc_id: r for r in dedup.signatures(dedup.shingle_sets(docs)).collect()}
    got = dedup.signed(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.sig == want[r.doc_id].sig and r.norm == (want[r.doc_id].norm if r.sig is None else None)


def test_signatures_are_made_once(spark, sf_dir):
    for name in ("D06_estimated_similarity", "J08_candidates_of_32_bands"):
        plan = R.queries[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        # before, the kernel stood in the plan two or more times
        assert "MapInArrow" not in plan
