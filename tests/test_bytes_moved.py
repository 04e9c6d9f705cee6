"""What is shuffled and written between the steps: nothing that a later step could work out or does not read."""

import datetime
import glob
import re

import pyarrow.parquet as pq

from checks import fixtures as fx
from stowage import schemas
from stowage.plans import ledger, rollback
from stowage.plans.rollback_batch import outcomes_in_order
from stowage.session import checkpoint_root, cut_lineage
from stowage.sources import CatalogueStore
from tests.test_rollback_ledger import ACTION, action

AT = datetime.datetime(2024, 1, 1)


def codecs(folder):
    files = glob.glob(f"{folder}/**/*.parquet", recursive=True)
    return {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups}


def test_written_tables_are_packed_tightly(spark, tmp_path):
    assert codecs(cut_lineage(spark.range(100)).work_folder) == {"ZSTD"}
    store = CatalogueStore(spark, str(tmp_path / "store"))
    store.append("scan_errors", spark.createDataFrame([("s", "/a", "e")], schemas.SCAN_ERRORS))
    assert codecs(store.path("scan_errors")) == {"ZSTD"}


def tables(spark, folder):
    # Rows that differ in status and date only, an unknown order, null keys and an order that comes twice.
    lines = [
        (1, 5, 7, 1, 2.0, 10.0, 0.1, 0.2, "N", "O", AT), (1, 5, 7, 1, 2.0, 10.0, 0.1, 0.2, "N", "F", AT), (1, 5, 7, 1, 2.0, 10.0, 0.1, 0.2, "A", "F", AT),
        (9, 5, 7, 1, 2.0, 10.0, 0.1, 0.2, "N", "O", AT), (None, 5, 7, 1, 2.0, 10.0, 0.1, 0.2, "N", "O", AT), (3, 6, 8, 2, 1.0, 1.0, 0.0, 0.0, "R", "F", AT),
    ]
    spark.createDataFrame(lines, """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,
        l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""").write.parquet(f"{folder}/lineitem.parquet")
    orders = [(1, 4, "O", AT), (3, 4, "F", AT), (3, 4, "F", AT), (None, 4, "F", AT)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    return fx._actions(spark, folder, fx._orders(spark, folder))


def test_actions_are_built_from_the_columns_they_need(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above_files = [line for line in plan.splitlines() if "Relation [" not in line]
    assert not any("l_linestatus" in line or "l_shipdate" in line for line in above_files)
    found = sorted((r.transaction_id, r.seq, r.type, r.status, r.from_path, r.to_path, r.file_size) for r in rows.collect())
    assert found == [
        ("tx-1", 1, "delete", "completed", "/data/p5/o1_1.txt", "/moved/s7/o1_1.txt", 2000),
        ("tx-1", 2, "delete", "failed", "/data/p5/o1_2.txt", "/moved/s7/o1_2.txt", 2000),
        ("tx-1", 3, "delete", "failed", "/data/p5/o1_3.txt", "/moved/s7/o1_3.txt", 2000),
        *[("tx-3", 1, "move", "completed", "/data/p6/o3_1.txt", "/moved/s8/o3_1.txt", 1000)] * 2,
    ]


def test_nested_deals_actions_out_once(spark):
    acts = spark.createDataFrame([action(i, "move", f"/a{i}", f"/b{i}", tx=t) for t in ("t", "u", None) for i in (2, 1, 3)], ACTION)
    heads = spark.createDataFrame([("t",), ("t",), ("empty",), (None,)], "transaction_id string")
    fields = ("seq", "type", "from_path", "status")
    plain, hot = (ledger.nested(heads, acts, 2, fields, hot_rows=n) for n in (10**6, 2))
    dealt = r"hashpartitioning\(transaction_id#\d+, [a-z_]"
    assert not re.search(dealt, plain._jdf.queryExecution().executedPlan().toString())
    assert re.search(dealt, hot._jdf.queryExecution().executedPlan().toString())
    rows = [sorted((str(r.transaction_id), r.page, tuple(a.seq for a in r.actions)) for r in d.collect()) for d in (plain, hot)]
    assert rows[0] == rows[1] == [("None", 0, ()), ("empty", 0, ()), *[("t", 0, (1, 2))] * 2, *[("t", 1, (3,))] * 2]
    assert plain.schema["actions"].dataType.elementType.names == list(fields)


def test_second_lookup_leaves_the_target_behind(spark):
    acts = spark.createDataFrame([action(1, "move", "/a", "/x"), action(2, "delete", "/b", "")], ACTION)
    present = spark.createDataFrame([("/x",), ("",)], "path string")
    judged = rollback.outcomes(acts, present)
    node = judged.select("transaction_id", "seq", "outcome")._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    assert "__path" in node.left().output().toString() and "to_path" not in node.left().output().toString()
    assert {r.seq: r.outcome for r in judged.collect()} == {1: "restored", 2: "skipped"}


def test_rounds_do_not_carry_paths(spark):
    before = set(glob.glob(f"{checkpoint_root(spark)}/judged-*"))
    acts = spark.createDataFrame([action(1, "move", f"/p{i}", f"/p{i + 1}", tx=f"t{i}") for i in range(3)], ACTION)
    order = spark.createDataFrame([("t2", 0), ("t1", 1), ("t0", 2)], "transaction_id string, place bigint")
    judged = outcomes_in_order(acts, order, spark.createDataFrame([("/p3",)], "path string"))
    assert [r.final_path for r in judged.orderBy("transaction_id").collect()] == ["/p0", "/p1", "/p2"]
    made = set(glob.glob(f"{checkpoint_root(spark)}/judged-*")) - before
    assert made and {spark.read.parquet(m).schema["path"].dataType.typeName() for m in made} == {"struct"}
