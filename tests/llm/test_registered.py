"""The registered queries of this package on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import TABLES, normal
from stowage.llm.oracle import ORACLE
from stowage.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["op1_secrets", "op2_toxicity", "op4_suffix_dedup", "op7_simhash", "op13_periodic_runs"])
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = QUERIES[name](spark, SF_DIR)
    assert rows.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and rows.count() == docs.count()
