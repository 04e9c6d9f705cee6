"""What undoing a transaction would do, each one looked at by itself.

Steps of one run do not depend on each other: targets of moves are unique and never a source of the
same run, so every step is judged against the set of present paths. Only restored deletes can clash
with each other; they get their names in rollback order. Any number of transactions can be looked at in one job as long as no
two of them touch one path; :mod:`stowage.plans.rollback_batch` undoes those that do, one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.hashing import action_id
from stowage.operators.collisions import resolve_names
from stowage.operators.skew import HOT_ROWS, hot_keys, lookup_with
from stowage.operators.topk import first_rows
from stowage.plans.ledger import outcome_status
from stowage.session import cut_lineage

# Texts of skipped steps and refusals.
TARGET_GONE = "File no longer exists at moved location"
PLACE_TAKEN = "Original location is no longer available (file exists)"
TRASH_GONE = "File was permanently deleted or trash file not found"
UNKNOWN_TYPE = "Unknown action type: "
NOT_FOUND = "Transaction not found: "
ALREADY_DONE = "Transaction has already been rolled back: "
WAS_DRY_RUN = "Cannot rollback a dry-run transaction: "


def eligibility(requested: DataFrame, transactions: DataFrame) -> DataFrame:
    """Requested ids with ``reason``, null when the transaction can be rolled back."""
    known = transactions.select("transaction_id", "status", "dry_run")
    reason = (
        F.when(F.col("status").isNull(), F.concat(F.lit(NOT_FOUND), "transaction_id"))
        .when(F.col("status") == "rolled_back", F.concat(F.lit(ALREADY_DONE), "transaction_id"))
        .when(F.col("dry_run"), F.concat(F.lit(WAS_DRY_RUN), "transaction_id"))
    )
    return requested.join(known, "transaction_id", "left").select("transaction_id", reason.alias("reason"))


def rollback_plan(actions: DataFrame) -> DataFrame:
    """Completed actions, last one first."""
    return actions.filter("status = 'completed'").orderBy("transaction_id", F.desc("seq"))


def _present(actions: DataFrame, paths: DataFrame, column: str, name: str, hot: DataFrame | None) -> DataFrame:
    right = paths.select(F.col("path").alias("__path"), F.lit(True).alias(name))
    keyed = actions.withColumn("__path", F.col(column))
    found = lookup_with(keyed, right, ["__path"], F.xxhash64("transaction_id", "seq"), hot)
    return found.withColumn(name, F.coalesce(name, F.lit(False))).drop("__path")


def rollback_order() -> Column:
    """Sort key of the steps: transactions by id, inside one the last action first."""
    return F.concat_ws("\0", "transaction_id", F.lpad((F.lit(10**18) - F.col("seq")).cast("string"), 19, "0"))


def outcomes(actions: DataFrame, present_paths: DataFrame, failures: DataFrame | None = None,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Outcome of every completed action: restored, skipped or failed, with the text and the final path.

    ``present_paths`` is a set of paths. ``failures`` (transaction_id, seq, error) holds steps the file
    system refused; without it no step fails. ``final_path`` is null here for restored deletes, see
    :func:`restored_paths`.
    """
    todo = actions.filter("status = 'completed'")
    # Very common paths, such as the blank target of permanent deletes, are found before anything is joined.
    hot = hot_keys(todo.select(F.explode(F.array("to_path", "from_path")).alias("__path")), ["__path"], hot_rows)
    todo = _present(todo, present_paths, "to_path", "target_there", hot)
    # At once, so that the second lookup need not carry the target along.
    todo = todo.withColumn("target_there", F.col("target_there") & (F.col("to_path") != ""))
    todo = _present(todo, present_paths, "from_path", "place_taken", hot)
    if failures is not None:
        refused = failures.select("transaction_id", "seq", F.col("error").alias("refusal"))
        todo = todo.join(refused, ["transaction_id", "seq"], "left")
    else:
        todo = todo.withColumn("refusal", F.lit(None).cast("string"))

    kind = F.col("type")
    there = F.col("target_there")
    skip = (
        F.when((kind == "move") & ~there, F.lit(TARGET_GONE))
        .when((kind == "move") & F.col("place_taken"), F.lit(PLACE_TAKEN))
        .when((kind == "delete") & ~there, F.lit(TRASH_GONE))
        .when(~kind.isin("move", "delete"), F.concat(F.lit(UNKNOWN_TYPE), kind))
    )
    outcome = (
        F.when(skip.isNotNull(), F.lit("skipped"))
        .when(F.col("refusal").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("restored"))
    )
    return todo.withColumn("outcome", outcome).withColumn("outcome_error", F.coalesce(skip, "refusal")).drop(
        "target_there", "refusal"
    )


def restored_paths(judged: DataFrame, present_paths: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Restored steps with the path each file gets: moves their old place, deletes the first free name."""
    restored = cut_lineage(judged.filter("outcome = 'restored'").drop("error"), "restored")
    moves = restored.filter("type = 'move'").withColumn("final_path", F.col("from_path")).withColumn(
        "error", F.lit(None).cast("string")
    )
    taken = present_paths.select("path").unionByName(moves.select(F.col("from_path").alias("path")))
    deletes = resolve_names(restored.filter("type = 'delete'"), taken, "from_path", rollback_order(), hot_rows)
    return moves.unionByName(deletes)


def rollback_actions(judged: DataFrame, rollback_id: Column) -> DataFrame:
    """Ledger rows of the rollback. Skipped steps are stored as completed, ``outcome`` tells them apart."""
    source = F.coalesce(F.nullif(F.col("to_path"), F.lit("")), F.col("from_path"))
    return judged.select(
        rollback_id.alias("transaction_id"), "seq", action_id(rollback_id, F.col("seq").cast("string")).alias("action_id"),
        F.lit("restore").alias("type"), source.alias("from_path"), F.col("from_path").alias("to_path"),
        F.when(F.col("outcome") == "failed", F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.col("outcome_error").alias("error"), "file_hash", "file_size", "outcome",
    )


def rollback_summary(judged: DataFrame) -> DataFrame:
    counts = judged.groupBy("transaction_id").agg(
        F.count("*").alias("total_actions"),
        *[F.count_if(F.col("outcome") == o).alias(f"{o}_count") for o in ("restored", "failed", "skipped")],
    )
    return counts.withColumn("status", outcome_status(F.lit(False), F.col("failed_count")))


def not_restored(judged: DataFrame, limit: int = 10) -> DataFrame:
    """First steps that were not restored, in rollback order, with how many are not shown."""
    return first_rows(judged.filter("outcome <> 'restored'"), [rollback_order()], limit)


def closing_events(undone: DataFrame, rollback_id: Column, at: Column) -> DataFrame:
    """The status event that closes each original, whatever its steps came to."""
    return undone.select(
        "transaction_id", F.lit(1).cast("bigint").alias("event_seq"), F.lit("rolled_back").alias("status"),
        at.alias("rolled_back_at"), rollback_id.alias("rollback_transaction_id"),
    )
