"""Every registered query against its SQL over the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canonical

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.sql(ORACLES[name])
    assert found == canonical(result.columns, result.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and set(df.columns) >= {"split", "pr_auc", "roc_auc"}
