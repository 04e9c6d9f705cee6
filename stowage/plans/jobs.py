"""Whole runs against a store: scan, dedupe, organize, rollback, report.

No run renames or deletes a file. Dedupe and organize write what has to be done (``dry_run``) or record
what was done: ``outcomes`` holds what the file system said about each step; without it every step
counts as done. A run is seen as a whole or not at all: repeated under its id after a crash it doubles nothing, and
when it was saved already, nothing is done.
"""

from __future__ import annotations

import datetime
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.categories import CATEGORIES
from stowage.functions.paths import order_key
from stowage.operators.progress import with_progress
from stowage.operators.skew import rank_within
from stowage.plans import dedupe, ledger, organize, report, rollback, rollback_batch, scan
from stowage.schemas import SUMMARY_FIELDS
from stowage.session import cut_lineage, discard
from stowage.sources.contents import hash_files
from stowage.sources.filesystem import is_remote
from stowage.sources.listing import list_each, walk
from stowage.sources.store import CatalogueStore, Run


def clean_root(root: str) -> str:
    """Trimmed and normalised, so that a trailing ``/`` does not hide the direct children."""
    root = root.strip()
    if is_remote(root):
        return root.rstrip("/")
    return re.sub("^/+", "/", os.path.normpath(root.removeprefix("file://")))


def run_scan(store: CatalogueStore, root: str, at: datetime.datetime, recursive: bool = True,
             scan_id: str | None = None) -> tuple[str, dict]:
    """List, hash and flag a tree, and save it. Returns the scan id and the job's row, byte and error counts (none if a scan of
    this id is saved already)."""
    root = clean_root(root)
    if not is_remote(root) and not os.path.isdir(root):
        raise ValueError(f"Directory does not exist: {root}")
    run = store.begin(scan_id)
    scan_id = run.run_id
    if run.done:
        return scan_id, {}
    listed, failed = walk(store.spark, root, recursive)
    run.append("scan_errors", failed.filter("NOT silent").withColumn("scan_id", F.lit(scan_id)))
    found = listed.withColumn("scan_id", F.lit(scan_id))
    watched, progress = with_progress(hash_files(found), "size", F.col("error").isNotNull())
    hashed = cut_lineage(watched, "hashed")
    run.append("scan_errors", hashed.filter("error IS NOT NULL"))
    readable = hashed.filter("error IS NULL").drop("error")
    run.append("file_records", scan.file_records(scan.build_manifest(readable), at))
    path = store.spark.createDataFrame([(scan_id, root)], "scan_id string, scanned_path string")
    run.append("scans", scan.scan_rows(run.read("file_records"), path, F.lit(at)))
    run.commit()
    discard(hashed)
    return scan_id, progress.get


def _numbered(actions: DataFrame) -> DataFrame:
    """Actions with ``seq`` in walk order. One run may hold all rows, so the rank is the skew-safe one."""
    plain = actions.withColumn("outcome", F.lit(None).cast("string"))
    return rank_within(plain, ["transaction_id"], [order_key("from_path")], "seq")


def _save(run: Run, actions: DataFrame, kind: str, target: str, dry_run: bool, strategy: str | None, at: datetime.datetime) -> str:
    """Actions, counted header and whatever the run has written before, made visible together."""
    transaction_id = run.run_id
    run.append("actions", actions)
    saved = run.read("actions")
    head = run.store.spark.createDataFrame(
        [(transaction_id, kind, target, dry_run, strategy)],
        "transaction_id string, type string, target_path string, dry_run boolean, strategy string",
    )
    counted = ledger.transaction_summary(head, saved)
    run.append("transactions", counted.select(
        "transaction_id", F.lit(None).alias("scan_id"), "type",
        ledger.outcome_status(F.col("dry_run"), F.col("failed_count")).alias("status"),
        F.struct(*SUMMARY_FIELDS).alias("summary"), "target_path", "dry_run", "strategy", F.lit(at).alias("created_at"),
        F.when(~F.col("dry_run"), F.lit(at)).alias("completed_at"),
    ))
    run.commit()
    return transaction_id


def _files_now(store: CatalogueStore, scan_id: str) -> DataFrame:
    """Files of a scan as earlier runs have left them."""
    records = scan.records_of_scan(store.file_records(), scan_id)
    return ledger.current_files(records, store.actions(), store.transactions())


def _lying(store: CatalogueStore, folders: list[str]) -> DataFrame:
    """Paths that lie in some folders now; folders that are not there hold nothing."""
    files, _ = list_each(store.spark.createDataFrame([(f,) for f in folders], "file_path string"))
    return files.select(F.col("file_path").alias("path"))


def _recorded(planned: DataFrame, places: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """Actions after the run. ``places`` are the resolved names (from_path, final_path, error)."""
    if outcomes is None:
        outcomes = places.select("from_path", F.col("error").isNull().alias("ok"), "error", "final_path")
    return ledger.record_outcomes(planned, outcomes, ["from_path"])


def run_dedupe(store: CatalogueStore, scan_id: str, at: datetime.datetime, strategy: str = dedupe.DEFAULT_STRATEGY,
               dry_run: bool = False, trash: str | None = None, outcomes: DataFrame | None = None,
               transaction_id: str | None = None, existing: DataFrame | None = None) -> str:
    """Delete all but one copy of a scan's duplicates, into ``trash`` or for good.

    Files deleted or moved by earlier runs are taken as those left them. ``existing`` (path) are the names in the trash; without
    it the folder is listed.
    """
    run = store.begin(transaction_id)
    transaction_id = run.run_id
    if run.done:
        return transaction_id
    files = _files_now(store, scan_id)
    planned = cut_lineage(
        dedupe.delete_actions(dedupe.removals(files, strategy), F.lit(transaction_id), trash), "removals"
    )
    actions = planned
    if not dry_run:
        if trash:
            millis = int(at.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
            lying = _lying(store, [trash.rstrip("/")]) if existing is None else existing.select("path")
            places = dedupe.trash_targets(planned, trash, millis, lying)
        else:
            places = planned.select("from_path", F.lit("").alias("final_path"), "error")
        actions = _recorded(planned, places, outcomes)
    root = _scanned_path(store, scan_id)
    return _save(run, _numbered(actions), "dedupe", root, dry_run, strategy, at)


def _scanned_path(store: CatalogueStore, scan_id: str) -> str:
    found = scan.scan_by_id(store.scans(), scan_id).select("scanned_path").first()
    if found is None:
        raise ValueError(f"Scan not found: {scan_id}")
    return found[0]


def run_organize(store: CatalogueStore, scan_id: str, at: datetime.datetime, recursive: bool = False,
                 dry_run: bool = False, outcomes: DataFrame | None = None, transaction_id: str | None = None,
                 existing: DataFrame | None = None) -> str:
    """Move a scan's files into category folders below its root.

    Files deleted or moved by earlier runs are taken as those left them. ``existing`` (path) are the names in the category folders;
    without it these are listed.
    """
    run = store.begin(transaction_id)
    transaction_id = run.run_id
    if run.done:
        return transaction_id
    root = _scanned_path(store, scan_id)
    files = _files_now(store, scan_id)
    plan = organize.organize_plan(files, F.lit(root), recursive)
    actions = organize.move_actions(
        plan.withColumn("final_path", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")),
        F.lit(transaction_id),
    ).withColumn("status", F.lit("pending"))
    if not dry_run:
        lying = _lying(store, [f"{root.rstrip('/')}/{c}" for c in CATEGORIES]) if existing is None else existing.select("path")
        places = organize.resolved_moves(plan, organize.settled_paths(files).union(lying).distinct())
        actions = _recorded(actions, places, outcomes)
    return _save(run, _numbered(actions), "organize", root, dry_run, None, at)


def run_rollback(store: CatalogueStore, transaction_id: str, present_paths: DataFrame, at: datetime.datetime,
                 failures: DataFrame | None = None, rollback_id: str | None = None) -> str:
    """Undo one transaction. ``present_paths`` is the set of paths that exist now."""
    return run_rollbacks(store, [transaction_id], present_paths, at, failures, rollback_id and [rollback_id])[0]


def run_rollbacks(store: CatalogueStore, transaction_ids: list[str], present_paths: DataFrame, at: datetime.datetime,
                  failures: DataFrame | None = None, rollback_ids: list[str] | None = None) -> list[str]:
    """Undo transactions one after another, in the order given, each with a rollback of its own.

    Every step is judged against the paths as the steps before it leave them. Nothing is saved when one of the transactions
    cannot be rolled back. Under the same ids after a crash it saves the rollbacks that are missing; ``present_paths`` are still
    those from before the first of them.
    """
    spark = store.spark
    runs = [store.begin(i) for i in rollback_ids or [None] * len(transaction_ids)]
    states = ledger.current_state(store.transactions(), store.status_events())
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(transaction_ids)], "transaction_id string, place bigint")
    named = states.join(asked.select("transaction_id"), "transaction_id", "left_semi")
    reasons = {r["transaction_id"]: r["reason"] for r in rollback.eligibility(asked, named).collect()}
    for i, (one, run) in enumerate(zip(transaction_ids, runs)):
        reason = reasons[one] or (rollback.ALREADY_DONE + one if one in transaction_ids[:i] else None)
        if reason and not run.done:
            raise ValueError(reason)
    targets = {r["transaction_id"]: r["target_path"] for r in named.select("transaction_id", "target_path").collect()}
    mine = store.actions().join(asked.select("transaction_id"), "transaction_id", "left_semi")
    judged = cut_lineage(rollback_batch.outcomes_in_order(mine, asked, present_paths, failures), "undone")
    for one, run in zip(transaction_ids, runs):
        if run.done:
            continue
        steps = judged.filter(F.col("transaction_id") == one)
        undo = rollback.rollback_actions(steps, F.lit(run.run_id)).join(steps.select("seq", "final_path"), "seq")
        # The last action is undone first, so its step is number one.
        last = mine.filter(F.col("transaction_id") == one).agg(F.max("seq")).first()[0] or 0
        undo = undo.withColumn("to_path", F.coalesce("final_path", "to_path")).withColumn("seq", F.lit(last + 1) - F.col("seq"))
        # The original is closed even when it had no step to undo.
        run.append("status_events", rollback.closing_events(asked.filter(F.col("transaction_id") == one), F.lit(run.run_id), F.lit(at)))
        _save(run, undo, "rollback", targets[one], False, None, at)
    discard(judged)
    return [run.run_id for run in runs]


def run_report(store: CatalogueStore) -> DataFrame:
    """The whole report as one nested row."""
    states = ledger.current_state(store.transactions(), store.status_events())
    return report.full_report(store.file_records(), store.scans(), states)
