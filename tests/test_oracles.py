"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from folioscope.plans import registered

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registered()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def order(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(v) for v in row) for row in cursor.fetchall()), key=order)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, rows", [("correlated_count", "orders"), ("issue_match", "events where event_id % 2 = 0"), ("number_claims", "documents"), ("artifact_stripping", "documents"), ("document_summary", "documents"), ("embedding_text_build", "documents"), ("vector_literals", "embeddings"), ("answer_validation", "conversations"), ("asset_scan", "pages where page_id % 3 <> 0 or page_id % 2 = 0")])
def test_whole_tables(spark, duck, name, rows):
    assert QUERIES[name](spark, FOLDER).count() == duck.execute(f"select count(*) from {rows}").fetchone()[0]
