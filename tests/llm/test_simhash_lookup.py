"""The lookup of SimHash halves never goes to the driver, and finds what comparing all pairs finds."""

import random

from quillstone.llm import simhash
from quillstone.operators import components


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_lookup_is_a_merge_and_whole(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 5)})
    fps = spark.createDataFrame([(_signed(x),) for x in prints], "fp bigint")
    found = simhash.links(fps)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # the balls' rows are read from a small table, yet are many
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan
    got = {(r.a, r.b) for r in found.collect()}
    want = {(_signed(x), _signed(y)) for x in prints for y in prints if x != y and (x ^ y).bit_count() <= 3}
    assert {p for p in want if p[0] > p[1]} <= {(max(p), min(p)) for p in got} <= {(max(p), min(p)) for p in want}


def test_many_links_are_merged(spark, monkeypatch):
    plans, met = [], components._met
    monkeypatch.setattr(components, "MERGED", 1)
    monkeypatch.setattr(components, "_met", lambda *x: plans.append(met(*x)) or plans[-1])
    chain = spark.range(0, 40).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components.connected_components(chain).collect()} == {0}
    assert plans and all("Broadcast" not in p._jdf.queryExecution().sparkPlan().toString() for p in plans)
