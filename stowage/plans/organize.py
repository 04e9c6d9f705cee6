"""Moves into category folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.categories import CATEGORIES
from stowage.functions.hashing import action_id
from stowage.functions.paths import dirname, join_path, order_key, parent_name
from stowage.operators.collisions import resolve_names
from stowage.operators.skew import HOT_ROWS
from stowage.operators.topk import first_rows


def organizable(files: DataFrame, root: Column, recursive: bool = False) -> DataFrame:
    """Files whose own folder is not called like a category; only direct children unless recursive."""
    loose = files.filter(~parent_name("file_path").isin(*CATEGORIES))
    return loose if recursive else loose.filter(dirname("file_path") == root)


def organize_plan(files: DataFrame, root: Column, recursive: bool = False) -> DataFrame:
    """Planned moves ``<root>/<category>/<name>``, not yet made unique. ``files`` is a manifest."""
    folder = join_path(root, F.col("category"))
    return (
        organizable(files, root, recursive)
        .withColumn("target_dir", folder)
        .filter(dirname("file_path") != F.col("target_dir"))
        .select(
            "scan_id", F.col("file_path").alias("from_path"), join_path("target_dir", "file_name").alias("to_path"),
            "category", "file_name", "size",
        )
    )


def by_category(plan: DataFrame) -> DataFrame:
    """Planned moves per category, for each scan the largest number first."""
    counts = plan.groupBy("scan_id", "category").agg(F.count("*").alias("files"))
    return counts.orderBy("scan_id", F.desc("files"), "category")


def plan_preview(plan: DataFrame, limit: int = 20) -> DataFrame:
    """First moves of the plan in walk order, with how many are not shown."""
    return first_rows(plan, [order_key("from_path"), "scan_id"], limit)


def settled_paths(files: DataFrame) -> DataFrame:
    """Paths already inside category folders: the names a plan can clash with."""
    return files.filter(parent_name("file_path").isin(*CATEGORIES)).select(F.col("file_path").alias("path"))


def resolved_moves(plan: DataFrame, existing: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The plan with the names the files really get, moves taken in walk order."""
    return resolve_names(plan, existing, "to_path", order_key("from_path"), hot_rows)


def move_actions(moves: DataFrame, transaction_id: Column) -> DataFrame:
    """Ledger rows of resolved moves; a move without a free name fails."""
    return moves.select(
        transaction_id.alias("transaction_id"), "scan_id", action_id(transaction_id, "from_path").alias("action_id"),
        F.lit("move").alias("type"), "from_path", F.coalesce("final_path", "to_path").alias("to_path"),
        F.when(F.col("error").isNull(), F.lit("completed")).otherwise(F.lit("failed")).alias("status"), "error",
        F.lit(None).cast("string").alias("file_hash"), F.col("size").alias("file_size"), "category",
    )


def moved_files(files: DataFrame, actions: DataFrame) -> DataFrame:
    """Catalogue with the paths after the completed moves; ``original_path`` stays."""
    done = actions.filter("type = 'move' AND status = 'completed'").select(
        "scan_id", F.col("from_path").alias("file_path"), F.col("to_path").alias("__to")
    )
    moved = files.join(done, ["scan_id", "file_path"], "left").withColumn("file_path", F.coalesce("__to", "file_path"))
    return moved.withColumn("file_name", F.substring_index("file_path", "/", -1)).select(*files.columns)


def organize_summary(actions: DataFrame) -> DataFrame:
    """Per scan: planned, moved, failed, and the count per category as a map of at most 8 entries."""
    per = actions.groupBy("scan_id", "category").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "completed").alias("moved"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return per.groupBy("scan_id").agg(
        F.sum("n").alias("total_files"), F.sum("moved").alias("moved_count"), F.sum("failed").alias("failed_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"),
    )
