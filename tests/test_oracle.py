"""Every registered query against its DuckDB SQL (the driver's correctness gate), at sf0.001."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_compare import compare, duck

from tickflow.catalog import QUERIES as CATALOG

SQL = entry.oracle_sql()
NAMES = sorted(CATALOG)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["symbol", "interval", "timestamp"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(CATALOG) <= set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    if name not in SQL:
        assert df.count() > 0
        return
    r = compare(df, con, SQL[name])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["exact"], r
