"""Removal plans, their ledger rows, and the catalogue left afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.formats import round_half_up
from stowage.functions.hashing import action_id
from stowage.functions.paths import basename, order_key
from stowage.operators.collisions import resolve_names
from stowage.operators.keepone import GROUP, attach_kept, keep_order, kept_files, with_copies
from stowage.operators.skew import HOT_ROWS, hot_keys, lookup_with, rank_with
from stowage.session import cut_lineage

DEFAULT_STRATEGY = "keep-latest"


def removals(files: DataFrame, strategy: str = DEFAULT_STRATEGY, keys: list[str] = GROUP,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Files to delete: every copy but the kept one, with the path of the kept one."""
    return attach_kept(files, strategy, keys, hot_rows).filter(F.col("kept_path") != F.col("file_path"))


def ranked_copies(files: DataFrame, strategy: str = DEFAULT_STRATEGY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All members of the duplicate groups with their rank; rank 1 is kept."""
    hot = hot_keys(files, GROUP, hot_rows)
    # Counting alone tells the groups, and join and rank share one shuffle when no group is hot.
    groups = files.groupBy(*GROUP).agg(F.count("*").alias("copies")).filter("copies > 1")
    members = lookup_with(files, groups, GROUP, F.col("file_path"), hot).filter("copies > 1").drop("copies")
    ranked = rank_with(members, GROUP, keep_order(strategy), "rank", hot_rows, hot)
    return ranked.withColumn("is_kept", F.col("rank") == 1)


def delete_actions(doomed: DataFrame, transaction_id: Column, trash: str | None) -> DataFrame:
    """Planned actions. The planned trash path is not made unique; without trash it is ``''``."""
    to = F.concat(F.lit(trash.rstrip("/") + "/"), basename("file_path")) if trash else F.lit("")
    return doomed.select(
        transaction_id.alias("transaction_id"), action_id(transaction_id, "file_path").alias("action_id"),
        F.lit("delete").alias("type"), F.col("file_path").alias("from_path"), to.alias("to_path"),
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"),
        F.col("hash").alias("file_hash"), F.col("size").alias("file_size"),
    )


def trash_targets(actions: DataFrame, trash: str, run_millis: int, existing: DataFrame,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Unique places in the trash folder: ``<millis>_<name>`` and then the first free name."""
    named = actions.withColumn(
        "to_path", F.concat(F.lit(f"{trash.rstrip('/')}/{run_millis}_"), basename("from_path"))
    )
    return resolve_names(named.drop("error"), existing, "to_path", order_key("from_path"), hot_rows)


def surviving_files(files: DataFrame, actions: DataFrame) -> DataFrame:
    """Catalogue without the completed deletions. ``actions`` carries scan_id and from_path."""
    gone = actions.filter("type = 'delete' AND status = 'completed'").select("scan_id", F.col("from_path").alias("file_path"))
    return files.join(gone, ["scan_id", "file_path"], "left_anti")


def saved_bytes(planned: Column, deleted: Column, actions: Column) -> Column:
    """Planned bytes scaled by the share of actions done: what the ledger records."""
    return round_half_up(planned.cast("double") * (deleted.cast("double") / F.greatest(actions, F.lit(1))))


def dedupe_summary(files: DataFrame, actions: DataFrame, strategy: str = DEFAULT_STRATEGY,
                   dry_run: bool = False) -> DataFrame:
    """Per scan: groups, copies, deleted, failed and saved bytes (planned bytes on a dry run)."""
    groups = kept_files(files, strategy).groupBy("scan_id").agg(
        F.count("*").alias("groups"), F.sum(F.col("copies") - 1).alias("duplicate_files"),
        F.sum(F.col("total_size") - F.col("kept_size")).alias("planned_bytes"),
    )
    done = actions.groupBy("scan_id").agg(
        F.count("*").alias("actions"),
        F.count_if(F.col("status") == "completed").alias("deleted_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.sum(F.when(F.col("status") == "completed", F.col("file_size")).otherwise(0)).alias("saved_bytes_exact"),
    )
    scaled = saved_bytes(F.col("planned_bytes"), F.col("deleted_count"), F.col("actions"))
    return groups.join(done, "scan_id").select(
        "scan_id", "groups", "duplicate_files", "deleted_count", "failed_count",
        (F.col("planned_bytes") if dry_run else scaled).alias("saved_bytes"), "saved_bytes_exact",
    )


def progressive_candidates(
    files: DataFrame, partial: Callable[[DataFrame], DataFrame], full: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Files with a copy, read as little as possible.

    Only files that share their size are opened for the partial hash, and only those that share size and
    partial hash are read whole. ``partial`` adds ``partial_hash``, ``full`` adds ``hash``. Rows that move
    between the steps are paths and sizes, never contents.
    """
    same_size = with_copies(files, ["scan_id", "size"])
    # Cut here, or every later use of the hashes would read the files again.
    ends = cut_lineage(partial(same_size))
    same_ends = with_copies(ends, ["scan_id", "size", "partial_hash"])
    return cut_lineage(full(same_ends.drop("partial_hash")))
