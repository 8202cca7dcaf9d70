"""Connected components of a hub and of a chain, with and without written aggregates."""

import pytest

from quillstone.operators import components


@pytest.mark.parametrize("large", [components.LARGE, 1])
def test_hub_and_chain(spark, monkeypatch, large):
    monkeypatch.setattr(components, "LARGE", large)
    hub = spark.range(1, 20_000).selectExpr("id AS a", "CAST(0 AS BIGINT) AS b")
    chain = spark.range(50_000, 50_040).selectExpr("id AS a", "id + 1 AS b")
    odd = spark.createDataFrame([(70_000, 70_000), (None, 3), (80_001, 80_000), (80_000, 80_001)], "a bigint, b bigint")
    got = components.connected_components(hub.union(chain).union(odd))
    sizes = {r.root: r["count"] for r in got.groupBy("root").count().collect()}
    assert sizes == {0: 20_000, 50_000: 41, 80_000: 2}
    assert components.connected_components(odd.where("false")).count() == 0
