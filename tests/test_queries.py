"""Every query runs on the smallest tables and agrees with its oracle."""

import duckdb
import pytest

from quillstone import catalog
from quillstone.sources.tables import TABLES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


#: One or two of each family; the driver compares all of them at a larger size.
CHOSEN = ["audit_flags", "X03_doc_stats", "D08_near_clusters", "J03_benchmark_hits_first_owner", "D14_validation_leak", "A04_smoothed_bigrams", "A22_upper_median", "W12_covered_share", "A19_token_weighted_mean", "M16_router_fusion", "S15_page_text", "O11_chosen_and_rejected", "U05_true_jaccard", "M06_preference_losses", "X16_heading_split", "K01_shard_manifest", "x_session_window", "B01_parsed_actions"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_its_oracle(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(tuple(plain(dict(zip(names, row))[c]) for c in columns)) for row in result.fetchall())
    assert sorted(names) == columns and got == want


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
