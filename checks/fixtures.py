"""Catalogue tables derived from the given tables.

`documents` stands for files, `orders` and `lineitem` for transactions and actions, `pages` for a
second set of paths, `events` for activity.
"""

from __future__ import annotations

import datetime
import functools
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import action_id
from stowage.operators.skew import HOT_ROWS, hot_keys, lookup_with, rank_with
from stowage.plans import ledger, scan
from stowage.session import work_folder
from stowage.sources.filesystem import create_file
from stowage.sources.store import CatalogueStore

RUN_AT = datetime.datetime(2024, 2, 10)
RUN_MILLIS = 1707523200000
TRASH = "/data/.trash"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DOCUMENT_PATH = """concat('/data/', lang, '/s', CAST(doc_id % 20 AS STRING), '/b', CAST(doc_id div 240 AS STRING),
    '/doc_', CAST(doc_id % 48 AS STRING), CASE WHEN doc_id % 7 = 0 THEN '_1' ELSE '' END,
    element_at(array('.pdf','.JPG','.mp4','.mp3','.exe','.zip','.py','.xyz','','.tar.gz',
                     '.txt','.png','.json','.mkv','.TXT','.'), CAST(doc_id % 16 + 1 AS INT)))"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document: the result of walking and hashing a tree."""
    return table(spark, sf_dir, "documents").selectExpr(
        "lang AS scan_id", f"{DOCUMENT_PATH} AS file_path", "sha2(text, 256) AS hash",
        "CAST(octet_length(text) AS BIGINT) AS size",
        "timestampadd(SECOND, (doc_id * 7919) % 86400, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS file_created_at",
        "timestampadd(SECOND, (doc_id * 104729) % 86400, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS file_modified_at",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.build_manifest(listing(spark, sf_dir))


def root_of_scan() -> F.Column:
    return F.concat(F.lit("/data/"), "scan_id")


def scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("scan_id")).distinct().withColumn(
        "scanned_path", root_of_scan()
    )


def scan_time() -> F.Column:
    """de, es, fr, en in this order, one day apart: `en` is the newest."""
    place = F.array_position(F.array(*[F.lit(x) for x in ("de", "es", "fr", "en")]), F.col("scan_id")) - 1
    return F.timestamp_add("DAY", place.cast("int"), F.lit(datetime.datetime(2024, 2, 1)).cast("timestamp_ntz"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path part of every page address: no scheme, query or fragment."""
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")).alias("file_path"),
        F.octet_length("html").cast("bigint").alias("size"),
    )


#: What follows from a row of `orders`. Shuffles carry the row, which is shorter, and these are worked out behind them.
HEAD = {
    "transaction_id": "concat('tx-', CAST(tx_key AS STRING))",
    "type": "CASE tx_key % 3 WHEN 0 THEN 'organize' WHEN 1 THEN 'dedupe' ELSE 'rollback' END",
    "status": """CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'partially_completed'
                      WHEN tx_key % 2 = 0 THEN 'rolled_back' ELSE 'pending' END""",
    "dry_run": "(o_orderstatus = 'P' AND tx_key % 2 <> 0)",
    "created_at": "CAST(o_orderdate AS TIMESTAMP_NTZ)",
    "target_path": "concat('/data/p', CAST(o_custkey AS STRING))",
}


def _head(*names: str) -> dict[str, F.Column]:
    return {n: F.expr(HEAD[n]) for n in names}


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS tx_key", "o_orderstatus", "o_orderdate", "o_custkey")


def _actions(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    # Rows that are equal up to here give equal actions, so the other columns need not break ties.
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    ]
    lines, key = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_key"), *order), ["tx_key"]
    hot = hot_keys(lines, key)
    numbered = rank_with(lines, key, [F.col(c) for c in order], "seq", HOT_ROWS, hot)
    known = orders.select("tx_key", "o_orderstatus", F.lit(True).alias("known"))
    joined = lookup_with(numbered, known, key, F.col("seq"), hot).filter("known").withColumns(
        _head("transaction_id", "type", "status", "dry_run")).withColumnsRenamed({"type": "tx_type", "status": "tx_status"})
    rows = joined.selectExpr(
        "transaction_id", "seq",
        "CASE tx_type WHEN 'organize' THEN 'move' WHEN 'dedupe' THEN 'delete' ELSE 'restore' END AS type",
        """CASE WHEN dry_run THEN 'pending' WHEN l_returnflag = 'N' AND tx_status = 'partially_completed'
                THEN 'failed' ELSE 'completed' END AS status""",
        "CAST(l_quantity * 1000 AS BIGINT) AS file_size",
        """concat('/data/p', CAST(l_partkey AS STRING), '/o', CAST(tx_key AS STRING), '_', CAST(seq AS STRING), '.txt')
           AS from_path""",
        """CASE WHEN tx_type = 'dedupe' AND seq % 5 = 0 THEN '' ELSE concat('/moved/s', CAST(l_suppkey AS STRING),
                '/o', CAST(tx_key AS STRING), '_', CAST(seq AS STRING), '.txt') END AS to_path""",
    )
    return rows.select(
        "transaction_id", "seq", action_id("transaction_id", "from_path").alias("action_id"), "type", "from_path",
        "to_path", "status", F.when(F.col("status") == "failed", F.lit("File is locked/busy")).alias("error"),
        F.lit(None).cast("string").alias("file_hash"), "file_size", F.lit(None).cast("string").alias("outcome"),
    )


def _status_events(orders: DataFrame) -> DataFrame:
    """A finished rollback closes the dedupe with the key before it; dedupes first log their own end."""
    done = orders.filter(ledger.can_roll_back())
    first = done.filter("type = 'dedupe'").selectExpr(
        "transaction_id", "CAST(0 AS BIGINT) AS event_seq", "status", "CAST(NULL AS TIMESTAMP_NTZ) AS rolled_back_at",
        "CAST(NULL AS STRING) AS rollback_transaction_id",
    )
    closing = done.filter("type = 'rollback'").selectExpr(
        "concat('tx-', CAST(tx_key - 1 AS STRING)) AS transaction_id", "CAST(1 AS BIGINT) AS event_seq",
        "'rolled_back' AS status", "created_at AS rolled_back_at", "transaction_id AS rollback_transaction_id",
    )
    return first.unionByName(closing)


def _once(build):
    """Build a written table set once per Spark application and data folder."""
    made: dict[tuple[str, str], object] = {}

    @functools.wraps(build)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, os.path.normpath(sf_dir))
        if key not in made:
            made[key] = build(spark, sf_dir)
        return made[key]

    return get


@_once
def records_store(spark: SparkSession, sf_dir: str) -> CatalogueStore:
    """File records and scans as the library writes them."""
    store = CatalogueStore(spark, work_folder(spark, "records"))
    store.append("file_records", scan.file_records(manifest(spark, sf_dir), RUN_AT))
    store.append("scans", scan.scan_rows(store.file_records(), scan_paths(spark, sf_dir), scan_time()))
    return store


@_once
def ledger_store(spark: SparkSession, sf_dir: str) -> CatalogueStore:
    """Transactions, actions and status events as the library writes them."""
    store = CatalogueStore(spark, work_folder(spark, "ledger"))
    orders = _orders(spark, sf_dir)
    store.append("actions", _actions(spark, sf_dir, orders))
    counted = ledger.transaction_summary(orders.withColumns(_head("transaction_id")), store.actions())
    store.append("transactions", counted.withColumns(_head("type", "status", "dry_run", "created_at", "target_path")).select(
        "transaction_id", F.lit(None).cast("string").alias("scan_id"), "type", "status",
        F.struct("moved_count", "deleted_count", "restored_count", "failed_count", "saved_bytes", "total_processed").alias("summary"),
        "target_path", "dry_run", F.when(F.col("type") == "dedupe", F.lit("keep-latest")).alias("strategy"), "created_at",
        F.when(~F.col("dry_run"), F.col("created_at")).alias("completed_at"),
    ))
    store.append("status_events", _status_events(orders.withColumns(_head("transaction_id", "type", "status", "dry_run", "created_at"))))
    return store


def present_paths(actions: DataFrame) -> DataFrame:
    """Files that are there now: most targets, some original places. A set."""
    moved = actions.filter("to_path <> '' AND seq % 4 <> 0").select(F.col("to_path").alias("path"))
    return moved.union(actions.filter("seq % 6 = 0").select("from_path")).distinct()


def four_runs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions and actions that move, delete, restore and move again parts of the scanned files, by their size."""
    n, path = F.col("size") % 1155, F.col("file_path")
    first = F.when(n % 3 == 0, F.concat(path, F.lit(".m1"))).otherwise(path)
    bin_ = F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("/t"), first))
    back = (n % 5 != 0) | (n % 4 == 1)
    runs = [
        ("run1", "organize", "move", n % 3 == 0, path, F.concat(path, F.lit(".m1")), F.lit("completed"), F.lit(None)),
        ("run2", "dedupe", "delete", n % 5 == 0, first, bin_, F.lit("completed"), F.lit(None)),
        ("run3", "rollback", "restore", n % 5 == 0, F.when(bin_ == "", first).otherwise(bin_), first, F.lit("completed"),
         F.when((n % 4 == 1), "restored").otherwise("skipped")),
        ("run4", "organize", "move", back & (n % 7 == 0), first, F.concat(first, F.lit(".m4")), F.when(n % 11 == 0, "failed").otherwise("completed"), F.lit(None)),
    ]
    rows = None
    for run, _, kind, which, source, to, status, outcome in runs:
        part = records.filter(which).select(
            F.lit(run).alias("transaction_id"), F.row_number().over(Window.partitionBy("scan_id").orderBy("file_path")).cast("bigint").alias("seq"),
            F.lit(kind).alias("type"), source.alias("from_path"), to.alias("to_path"), status.alias("status"), outcome.cast("string").alias("outcome"))
        rows = part if rows is None else rows.unionByName(part)
    heads = records.sparkSession.createDataFrame(
        [(r[0], r[1], False, RUN_AT + datetime.timedelta(days=i)) for i, r in enumerate(runs, 1)],
        "transaction_id string, type string, dry_run boolean, created_at timestamp_ntz")
    return heads, rows


SHELF = "array('a.txt', 'a_1.txt', 'b', 'b_2', 'c.x', 'd')"


def shared_steps(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The actions on few paths for each part, so that transactions want the same places, and the paths that are there before."""
    parted = actions.withColumns({
        "part": F.regexp_extract("from_path", r"^(/data/p\d+)/", 1), "tx": F.expr("CAST(substring(transaction_id, 4) AS BIGINT)")})
    moved = f"concat(part, '/', element_at({SHELF}, CAST((tx * 5 + seq * 7 + 1) % 6 AS INT) + 1))"
    steps = parted.withColumns({
        "from_path": F.expr(f"concat(part, '/', element_at({SHELF}, CAST((tx + seq) % 6 AS INT) + 1))"),
        "to_path": F.expr(f"CASE WHEN to_path = '' THEN '' WHEN type = 'delete' THEN concat(part, '/.trash/', tx % 4) ELSE {moved} END"),
    }).drop("part", "tx")
    parts = parted.select("part", F.expr("CAST(substring(part, 8) AS BIGINT)").alias("n")).distinct()
    shelf = parts.selectExpr("part", "n", f"posexplode({SHELF}) AS (i, name)").filter("(n + i) % 3 = 0").selectExpr("concat(part, '/', name) AS path")
    trash = parts.selectExpr("part", "explode(sequence(0, 2)) AS i").selectExpr("concat(part, '/.trash/', i) AS path")
    return steps, shelf.union(trash)


TREE_PATH = """concat('/', lang, CASE doc_id % 11 WHEN 3 THEN '/.cache' WHEN 5 THEN '/node_modules' ELSE '' END,
    '/s', CAST(doc_id % 20 AS STRING), '/', CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END, 'doc ', CAST(doc_id AS STRING), '.txt')"""


@_once
def document_tree(spark: SparkSession, sf_dir: str) -> str:
    """Write every document as a file below the shared work folder; returns the root."""
    root = re.sub("^file:/+", "/", work_folder(spark, "tree"))

    def write(batches):
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                create_file(root + path, text.encode())
            yield pd.DataFrame({"files": [len(batch)]})

    docs = table(spark, sf_dir, "documents").selectExpr(f"{TREE_PATH} AS path", "text")
    docs.mapInPandas(write, "files bigint").agg(F.sum("files")).collect()
    return root


def tree_files(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Path, size and times of the written documents, from the table."""
    return table(spark, sf_dir, "documents").selectExpr(
        "lang AS scan_id", f"concat('{root}', {TREE_PATH}) AS file_path", "CAST(octet_length(text) AS BIGINT) AS size",
        "timestampadd(SECOND, (doc_id * 7919) % 86400, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS file_created_at",
        "timestampadd(SECOND, (doc_id * 104729) % 86400, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS file_modified_at",
    )


def activity(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("type"),
        F.round(F.col("value") * 100).cast("bigint").alias("size"),
    )
