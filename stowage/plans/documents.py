"""Results of runs as JSON documents, in pages, so that no document grows with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.paths import order_key
from stowage.operators.skew import HOT_ROWS, rank_within
from stowage.plans.ledger import PAGE
from stowage.schemas import SUMMARY_FIELDS

# The names in the documents.
SUMMARY_NAMES = {
    "moved_count": "movedCount", "deleted_count": "deletedCount", "restored_count": "restoredCount", "failed_count": "failedCount",
    "saved_bytes": "savedBytes", "total_processed": "totalProcessed",
}
FILE_NAMES = {
    "file_path": "path", "file_name": "name", "hash": "hash", "extension": "extension", "category": "category", "size": "size",
    "file_created_at": "createdAt", "file_modified_at": "modifiedAt", "is_duplicate": "isDuplicate", "duplicate_of": "duplicateOf",
}


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _pages(items: DataFrame, key: str, number: str, item: Column, page_size: int) -> DataFrame:
    """Arrays of at most ``page_size`` items for each key; ``number`` counts from 1 without gaps."""
    page = F.floor((F.col(number) - 1) / page_size).cast("bigint")
    lists = items.groupBy(key, page.alias("page")).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), item.alias("item")))).alias("l"))
    return lists.select(key, "page", F.col("l.item").alias("items"))


def _documents(heads: DataFrame, pages: DataFrame, key: str, head: list[Column], name: str) -> DataFrame:
    """One row (key, page, document) per page; a run without items has an empty page 0."""
    found = heads.join(pages, key, "left").withColumns({
        "page": F.coalesce("page", F.lit(0).cast("bigint")), "items": F.coalesce("items", F.array().cast(pages.schema["items"].dataType))})
    return found.select(key, "page", _json(F.struct(*head, "page", F.col("items").alias(name))).alias("document"))


def scan_documents(scans: DataFrame, records: DataFrame, page_size: int = PAGE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What a scan found: its totals, its categories and its files in walk order."""
    ranked = rank_within(records.select("scan_id", *FILE_NAMES), ["scan_id"], [order_key("file_path")], "n", hot_rows)
    files = F.struct(*[F.col(c).alias(n) for c, n in FILE_NAMES.items()])
    named = F.map_from_entries(F.array_sort(F.map_entries("categories")))  # at most 8
    head = [F.col("scan_id").alias("scanId"), F.col("scanned_path").alias("scannedPath"), F.col("total_files").alias("totalFiles"),
            F.col("total_size").alias("totalSize"), F.col("duplicates_count").alias("duplicatesCount"),
            F.col("duplicates_size").alias("duplicatesSize"), named.alias("categories")]
    return _documents(scans, _pages(ranked, "scan_id", "n", files, page_size), "scan_id", head, "files")


def run_documents(transactions: DataFrame, actions: DataFrame, page_size: int = PAGE) -> DataFrame:
    """What a dedupe, an organize or a rollback planned or did: its summary and its steps in order. The status of a rolled-back step
    is its outcome."""
    step = F.struct(
        F.col("from_path").alias("from"), F.col("to_path").alias("to"), F.coalesce("outcome", "status").alias("status"), "error",
        F.col("file_size").alias("size"))
    summary = F.struct(*[F.coalesce(f"summary.{f}", F.lit(0)).cast("bigint").alias(SUMMARY_NAMES[f]) for f in SUMMARY_FIELDS])
    head = [F.col("transaction_id").alias("transactionId"), "type", "status", F.col("target_path").alias("targetPath"),
            F.col("dry_run").alias("dryRun"), "strategy", summary.alias("summary")]
    return _documents(transactions, _pages(actions, "transaction_id", "seq", step, page_size), "transaction_id", head, "actions")
