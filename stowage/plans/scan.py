"""From a listing with hashes to the manifest, duplicate flags, groups and totals."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.categories import with_category
from stowage.functions.formats import percent
from stowage.functions.paths import basename
from stowage.operators.keepone import GROUP, attach_kept, kept_files
from stowage.operators.skew import HOT_ROWS
from stowage.operators.topk import first_rows

ORIGINAL = "keep-oldest"


def build_manifest(listing: DataFrame) -> DataFrame:
    """One row per file with name, extension and category. All native columns, no shuffle."""
    return with_category(listing).select(
        "scan_id", basename("file_path").alias("file_name"), "file_path", F.col("file_path").alias("original_path"),
        "hash", "extension", "category", "size", "file_created_at", "file_modified_at",
    )


def flag_duplicates(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``is_duplicate`` and ``duplicate_of``. The oldest file of a hash group is the original."""
    flagged = attach_kept(files, ORIGINAL, GROUP, hot_rows)
    copy = F.col("kept_path").isNotNull() & (F.col("kept_path") != F.col("file_path"))
    return flagged.withColumn("is_duplicate", copy).withColumn("duplicate_of", F.when(copy, F.col("kept_path"))).drop(
        "kept_path"
    )


def file_records(files: DataFrame, at: datetime.datetime) -> DataFrame:
    """Flagged manifest with its record times, ready for the store."""
    return flag_duplicates(files).withColumn("created_at", F.lit(at)).withColumn("updated_at", F.lit(at))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Hash groups of two or more: copies, bytes, and the bytes of all but the original."""
    return kept_files(files, ORIGINAL).select(
        *GROUP, "copies", "total_size", (F.col("total_size") - F.col("kept_size")).alias("wasted_size"),
        F.col("kept_path").alias("original"),
    )


def top_duplicate_groups(groups: DataFrame, limit: int = 10) -> DataFrame:
    """Largest waste first, with how many groups are not shown."""
    return first_rows(groups, [F.desc("wasted_size"), *GROUP], limit)


def scan_summary(files: DataFrame) -> DataFrame:
    """Totals per scan from the hash groups, without going back to the files.

    Equal content has equal size, so the size of the kept file is any size of the group; numeric
    aggregates keep the job in hash aggregation.
    """
    groups = files.groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("size").alias("kept_size")
    )
    return groups.groupBy("scan_id").agg(
        F.sum("n").alias("total_files"),
        F.sum("bytes").alias("total_size"),
        F.sum(F.col("n") - 1).alias("duplicates_count"),
        F.sum(F.col("bytes") - F.col("kept_size")).alias("duplicates_size"),
    )


def summary_of_records(records: DataFrame) -> DataFrame:
    """The same totals from records that already carry their flags."""
    flag = F.col("is_duplicate")
    return records.groupBy("scan_id").agg(
        F.count("*").alias("total_files"),
        F.sum("size").alias("total_size"),
        F.count_if(flag).alias("duplicates_count"),
        F.sum(F.when(flag, F.col("size")).otherwise(0)).alias("duplicates_size"),
    )


def scan_categories(files: DataFrame) -> DataFrame:
    """Files, bytes and whole-number share per scan and category."""
    per = files.groupBy("scan_id", "category").agg(F.count("*").alias("count"), F.sum("size").alias("size"))
    totals = per.groupBy("scan_id").agg(F.sum("size").alias("bytes"))
    return per.join(totals, "scan_id").select(
        "scan_id", "category", "count", "size", percent(F.col("size"), F.col("bytes")).alias("pct")
    )


def categories_by_size(files: DataFrame) -> DataFrame:
    """The categories of each scan, the largest first."""
    return scan_categories(files).orderBy("scan_id", F.desc("size"), "category")


def scan_rows(records: DataFrame, paths: DataFrame, at: Column) -> DataFrame:
    """Scan headers: totals plus the map of categories. ``paths`` has scan_id and scanned_path."""
    entry = F.struct(F.col("count"), F.col("size"))
    maps = scan_categories(records).groupBy("scan_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", entry))).alias("categories")  # at most 8 entries
    )
    return (
        summary_of_records(records).join(maps, "scan_id").join(paths, "scan_id")
        .withColumn("created_at", at).withColumn("updated_at", at)
    )


def directory_size(files: DataFrame) -> DataFrame:
    """Bytes below every folder. Files are summed per folder first; only the folders count for each one above them."""
    folder = F.regexp_extract("file_path", r"(?s)^(.*)/", 1)
    own = files.filter(F.contains("file_path", F.lit("/"))).groupBy("scan_id", folder.alias("own")).agg(
        F.count("*").alias("files"), F.sum("size").alias("size")
    )
    parts = F.split("own", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return (
        own.select("scan_id", "files", "size", F.explode(above).alias("folder"))
        .groupBy("scan_id", F.when(F.col("folder") == "", F.lit("/")).otherwise(F.col("folder")).alias("folder"))
        .agg(F.sum("files").alias("files"), F.sum("size").alias("size"))
    )


def records_of_scan(records: DataFrame, scan_id: str) -> DataFrame:
    return records.filter(F.col("scan_id") == scan_id)


def duplicates_of_scan(records: DataFrame, scan_id: str) -> DataFrame:
    return records_of_scan(records, scan_id).filter("is_duplicate")


def scan_by_id(scans: DataFrame, scan_id: str) -> DataFrame:
    return scans.filter(F.col("scan_id") == scan_id)


def recent_scans(scans: DataFrame, limit: int = 10) -> DataFrame:
    return scans.orderBy(F.desc("created_at"), "scan_id").limit(limit)


def latest_scan(scans: DataFrame) -> DataFrame:
    return recent_scans(scans, 1)
