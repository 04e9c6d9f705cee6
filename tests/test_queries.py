"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.compare import TABLES, normal

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
NO_SQL = set()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_sql_but_the_nested_report():
    assert set(QUERIES) - set(ORACLE) == NO_SQL
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in NO_SQL:
        assert len(rows) == 1
        return
    cursor = sql.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.columns, rows) == normal(columns, cursor.fetchall())


def test_entry(spark):
    assert 0 < entry(spark).count() <= 10
