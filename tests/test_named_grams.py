"""Grams go by their names, never as rows of text; ids that rows share are put together as the SQL does."""

import duckdb
import pytest

from quillstone.queries.measures import R


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    text = "a b c d e f g a b c d e f"
    rows = [(1, text), (1, "a b c d e"), (2, text), (None, text), (None, "a b c d e"), (3, None), (4, "x y"), (5, "p " + text), (6, "q r s t u v")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(map(str, range(15))))], "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", ["A02_repetition", "W01_shingles", "U01_distinct_grams", "U05_true_jaccard"])
def test_grams_are_never_rows_of_text(spark, sf_dir, odd, name):
    # before, every gram was exploded as text and shuffled
    plan = R.queries[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    df = R.queries[name](spark, odd)
    cursor = con.execute(R.oracles[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(repr(dict(sorted(zip(columns, r)))) for r in cursor.fetchall())
    assert sorted(repr(dict(sorted(r.asDict().items()))) for r in df.collect()) == want
