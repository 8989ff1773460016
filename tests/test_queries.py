"""Every registered query against its check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, data, key):
    ok, note = check(spark, con, data, key, QUERIES[key], ORACLES.get(key))
    assert ok, note


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0]["score"] <= 100


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
