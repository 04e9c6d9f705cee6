"""Shape of the physical plans."""

import os
import re

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.queries import QUERIES
from stowage.functions import with_category
from stowage.operators import lookup
from stowage.operators.collisions import _parents
from stowage.operators.keepone import kept_files
from stowage.plans import dedupe, report, scan

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
PYTHON_NODES = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups", "MapInArrow")
ON_FILES = {"list_tree", "list_flat", "scan_errors", "dedupe_progressive", "full_hash", "partial_hash", "stream_duplicates"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ON_FILES))
def test_native_and_without_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not any(node in text for node in PYTHON_NODES)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_category_lookup_is_a_broadcast_join_without_shuffle(spark):
    text = plan(with_category(fx.listing(spark, SF_DIR)))
    assert "BroadcastHashJoin [extension" in text and "Exchange hashpartitioning" not in text


def test_totals_shuffle_files_once_and_hash_aggregate(spark):
    text = plan(scan.scan_summary(fx.listing(spark, SF_DIR)))
    assert text.count("Exchange hashpartitioning(scan_id") == 2 and "SortAggregate" not in text
    assert text.count("Exchange hashpartitioning(scan_id#") == 2  # groups, then four rows


def test_keep_one_combines_before_the_shuffle(spark):
    text = plan(scan.duplicate_groups(fx.listing(spark, SF_DIR)))
    assert "SortAggregate" not in text and text.count("Exchange") == 1
    for strategy in ("keep-latest", "keep-oldest", "keep-largest"):
        flagged = plan(dedupe.removals(fx.listing(spark, SF_DIR), strategy))
        assert "SortAggregate" not in flagged and flagged.count("Exchange") == 1


def test_keep_one_of_hot_groups_combines_before_the_shuffle(spark):
    files = fx.listing(spark, SF_DIR).withColumn("hash", F.lit("hot"))
    text = plan(kept_files(files, hot_rows=10))
    # Numbers are combined in hash aggregates; a task hands on one path for each group.
    assert "SortAggregate" not in text and text.count("WindowGroupLimit") == 2
    counted = next(l for l in text.splitlines() if "partial_min" in l)
    assert "HashAggregate" in counted and "file_path" not in counted and "__walk" not in counted


def test_one_scan_reads_one_partition(spark):
    store = fx.records_store(spark, SF_DIR)
    for rows in (scan.records_of_scan(store.file_records(), "fr"), report.top_duplicated_extensions(store.file_records(), store.scans())):
        line = next(l for l in plan(rows).splitlines() if "FileScan" in l)
        assert "PartitionFilters: [isnotnull(scan_id" in line
    stats = plan(report.extension_stats(store.file_records(), store.scans()))
    assert "TakeOrderedAndProject" in stats and "ReadSchema: struct<extension:string,size:bigint>" in stats


def test_contents_never_travel_with_the_removals(spark):
    text = plan(dedupe.removals(fx.records_store(spark, SF_DIR).file_records().drop("is_duplicate", "duplicate_of")).select("file_path", "kept_path"))
    read = [l.split("ReadSchema")[1] for l in text.splitlines() if "ReadSchema" in l]
    assert all("original_path" not in r and "category" not in r for r in read)


@pytest.fixture
def no_help(spark):
    """Without broadcasts and adaptive execution only the plan itself can balance the tasks."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_files_of_a_hot_name_are_limited_before_they_meet(spark, no_help):
    wanted = spark.createDataFrame([("/d", "a", str(i)) for i in range(1000)], "dir string, name string, __order string")
    edges = spark.createDataFrame([("/d", "a_1", "a", 1, "2")], "dir string, name string, parent string, slot int, first string")
    hot = spark.createDataFrame([("/d", "a", 1000)], "dir string, name string, n bigint")
    df = _parents(wanted, edges, hot, 100)
    text = plan(df)
    assert len(re.findall(r"Exchange hashpartitioning\(dir#\d+, name#\d+, part#\d+L?", text)) == 2  # both sides of the join
    assert text.count("WindowGroupLimit") >= 3
    assert len(df.first()["if_free"]) == 1000 and df.first()["if_free"] == _parents(wanted, edges).first()["if_free"]


def test_a_hot_key_is_spread_by_the_lookup(spark, no_help):
    rows = spark.range(20_000).selectExpr("if(id % 5 < 4, 'hot', concat('k', id)) AS k", "id")
    right = spark.range(0, 20_000, 7).selectExpr("concat('k', id) AS k", "id AS w").union(spark.createDataFrame([("hot", -1)], "k string, w bigint"))
    df = lookup(rows, right, ["k"], F.col("id"), hot_rows=1000)
    assert plan(df).count("Exchange hashpartitioning(k#") == len(re.findall(r"Exchange hashpartitioning\(k#\d+, __salt#", plan(df))) == 2
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 3 * 20_000 / 16
