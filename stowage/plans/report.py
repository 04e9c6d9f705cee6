"""Sections of the report, each a lazy DataFrame over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.formats import as_json, default_count, label_extension, percent
from stowage.operators.topk import one_row
from stowage.plans.ledger import recent
from stowage.plans.scan import latest_scan, recent_scans

SCAN_FIELDS = [
    "scan_id", "scanned_path", "total_files", "total_size", "duplicates_count", "duplicates_size", "created_at",
]


def _of_latest(records: DataFrame, scans: DataFrame) -> DataFrame:
    """Records of the newest scan. Its id is looked up first, so only that partition is read."""
    newest = latest_scan(scans).select("scan_id").first()
    return records.filter(F.col("scan_id") == newest[0]) if newest else records.filter(F.lit(False))


def overview(records: DataFrame, scans: DataFrame, transactions: DataFrame, scope: str = "all") -> DataFrame:
    """One row of counts. Every scan counts, so a rescan counts its files again; ``scope='latest'`` does not."""
    if scope not in ("all", "latest"):
        raise ValueError("scope is 'all' or 'latest'")
    files = records if scope == "all" else _of_latest(records, scans)
    return one_row([
        scans.agg(F.count("*").alias("total_scans")),
        files.agg(F.count("*").alias("total_files_scanned"),
                  F.count_if("is_duplicate").alias("total_duplicates_found")),
        space_saved(transactions),
    ])


def space_saved(transactions: DataFrame) -> DataFrame:
    """Bytes saved by dedupes that were not dry runs, and the number of transactions.

    ``total_disk_space_saved`` subtracts rolled-back runs though they are no longer in the sum;
    ``space_saved_net`` is the plain sum.
    """
    real = (F.col("type") == "dedupe") & ~F.col("dry_run")
    amount = default_count("summary.saved_bytes")
    kept = F.sum(F.when(real & F.col("status").isin("completed", "partially_completed"), amount).otherwise(0))
    undone = F.sum(F.when(real & (F.col("status") == "rolled_back"), amount).otherwise(0))
    return transactions.agg(kept.alias("kept"), undone.alias("undone"), F.count("*").alias("total_transactions")).select(
        default_count(F.greatest(F.lit(0), F.col("kept") - F.col("undone"))).alias("total_disk_space_saved"),
        default_count("kept").alias("space_saved_net"),
        "total_transactions",
    )


def category_breakdown(scans: DataFrame) -> DataFrame:
    """Categories of the newest scan with their whole-number share, largest first; at most 8 rows."""
    newest = latest_scan(scans)
    whole = F.aggregate(
        F.map_values("categories"), F.lit(0).cast("bigint"), lambda total, entry: total + entry["size"]
    )
    return (
        newest.select(whole.alias("whole"), F.explode("categories").alias("category", "entry"))
        .select(
            "category", F.col("entry.count").alias("file_count"), F.col("entry.size").alias("total_size"),
            percent(F.col("entry.size"), F.col("whole")).alias("percentage"),
        )
        .orderBy(F.desc("total_size"), "category")
    )


def extension_stats(records: DataFrame, scans: DataFrame, scope: str = "all", limit: int = 10) -> DataFrame:
    files = records if scope == "all" else _of_latest(records, scans)
    return (
        files.groupBy("extension")
        .agg(F.count("*").alias("count"), F.sum("size").alias("total_size"))
        .orderBy(F.desc("count"), "extension")
        .limit(limit)
        .select(label_extension("extension").alias("extension"), "count", "total_size")
    )


def recent_scan_rows(scans: DataFrame, limit: int = 5) -> DataFrame:
    return recent_scans(scans, limit).select(*SCAN_FIELDS)


def recent_activity(transactions: DataFrame, limit: int = 10) -> DataFrame:
    fields = ("moved_count", "deleted_count", "restored_count", "saved_bytes")
    return recent(transactions, limit).select(
        "transaction_id", "type", "status", *[default_count(f"summary.{f}").alias(f) for f in fields], "created_at"
    )


def duplicate_stats(records: DataFrame, scans: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """Groups, files and wasted bytes of the newest scan, zero when there is no scan. ``newest`` are its records, if known."""
    newest = _of_latest(records, scans) if newest is None else newest
    totals = one_row([
        newest.filter("is_duplicate").agg(F.countDistinct("hash").alias("total_groups")),
        latest_scan(scans).select(
            F.col("duplicates_count").alias("total_duplicate_files"), F.col("duplicates_size").alias("total_wasted_space")
        ),
    ])
    return totals.select(*[default_count(c).alias(c) for c in totals.columns])


def top_duplicated_extensions(records: DataFrame, scans: DataFrame, limit: int = 5, newest: DataFrame | None = None) -> DataFrame:
    newest = _of_latest(records, scans) if newest is None else newest
    return (
        newest.filter("is_duplicate")
        .groupBy("extension").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "extension").limit(limit)
        .select(label_extension("extension").alias("extension"), "count")
    )


def _document(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """A bounded section as one row holding one ordered array."""
    item = F.struct(*[F.col(c) for c in [*order, *[c for c in rows.columns if c not in order]]])
    plain = lambda e: F.struct(*[e[c].alias(c) for c in rows.columns if not c.startswith("__")])
    return rows.agg(F.transform(F.array_sort(F.collect_list(item)), plain).alias(name))


def full_report(records: DataFrame, scans: DataFrame, transactions: DataFrame) -> DataFrame:
    """The whole report as one nested row. Every array is a bounded section (10 rows or fewer)."""
    def falling(rows: DataFrame, column: str) -> DataFrame:
        key = F.col(column)
        return rows.withColumn("__down", -(F.unix_micros(key.cast("timestamp")) if column == "created_at" else key))

    newest = _of_latest(records, scans)
    sections = {
        "recent_scans": (falling(recent_scan_rows(scans), "created_at"), ["__down", "scan_id"]),
        "category_breakdown": (falling(category_breakdown(scans), "total_size"), ["__down", "category"]),
        "extension_stats": (falling(extension_stats(records, scans), "count"), ["__down", "extension"]),
        "recent_activity": (falling(recent_activity(transactions), "created_at"), ["__down", "transaction_id"]),
        "top_duplicated_extensions": (
            falling(top_duplicated_extensions(records, scans, newest=newest), "count"), ["__down", "extension"]
        ),
    }
    parts = [overview(records, scans, transactions).select(F.struct("*").alias("overview"))]
    parts += [_document(rows, name, order) for name, (rows, order) in sections.items()]
    parts.append(duplicate_stats(records, scans, newest).select(F.struct("*").alias("duplicate_stats")))
    return one_row(parts)


def report_json(records: DataFrame, scans: DataFrame, transactions: DataFrame) -> DataFrame:
    return as_json(full_report(records, scans, transactions), "report")
