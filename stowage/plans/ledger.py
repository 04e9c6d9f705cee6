"""Transactions and actions: outcomes, counters, states and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.paths import basename
from stowage.operators.skew import HOT_ROWS, hot_keys, lookup
from stowage.session import cut_lineage, discard

# Error codes of the file system and their texts.
ERROR_TEXTS = {"EACCES": "Permission denied", "EBUSY": "File is locked/busy", "ENOENT": "File not found"}
UNKNOWN_ERROR = "Unknown error"
ROLLBACKABLE = ("completed", "partially_completed")


def error_reason(code: Column | str, message: Column | str, move: bool = True) -> Column:
    """Text of a failed step. Only moves translate a missing file; other codes show their message."""
    code = F.col(code) if isinstance(code, str) else code
    message = F.col(message) if isinstance(message, str) else message
    text = F.coalesce(F.nullif(message, F.lit("")), F.lit(UNKNOWN_ERROR))
    known = {c: t for c, t in ERROR_TEXTS.items() if move or c != "ENOENT"}
    for name, reason in known.items():
        text = F.when(code == name, F.lit(reason)).otherwise(text)
    return text


def record_outcomes(planned: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Planned actions with what happened: a row without outcome stays pending, a failed one keeps its error.

    ``outcomes`` has the keys, ok BOOLEAN, error and final_path (the place really taken, or null).
    """
    joined = planned.drop("status", "error").join(outcomes, keys, "left")
    status = (
        F.when(F.col("ok").isNull(), F.lit("pending")).when(F.col("ok"), F.lit("completed")).otherwise(F.lit("failed"))
    )
    return (
        joined.withColumn("status", status)
        .withColumn("error", F.when(~F.col("ok"), F.col("error")))
        .withColumn("to_path", F.when(F.col("ok"), F.coalesce("final_path", "to_path")).otherwise(F.col("to_path")))
        .drop("ok", "final_path")
    )


def counters(actions: DataFrame) -> DataFrame:
    """The six counters of each transaction that has actions. Dry runs save nothing.

    A skipped rollback step is stored as completed; its ``outcome`` keeps it out of the restored count.

    Counts combine map-side, so a transaction of any size sends one row per task.
    """
    done = F.col("status") == "completed"

    def completed(kind: str) -> Column:
        return F.count_if(done & (F.col("type") == kind))

    deletes = F.col("type") == "delete"
    totals = actions.groupBy("transaction_id").agg(
        completed("move").alias("moved_count"), completed("delete").alias("deleted_count"),
        F.count_if(done & (F.col("type") == "restore") & (F.coalesce("outcome", F.lit("restored")) == "restored"))
        .alias("restored_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.sum(F.when(deletes, F.col("file_size")).otherwise(0)).alias("__planned"),
        F.sum(F.when(deletes & done, F.col("file_size")).otherwise(0)).alias("saved_bytes_exact"),
        F.count("*").alias("total_processed"),
    )
    share = F.col("deleted_count").cast("double") / F.greatest("total_processed", F.lit(1))
    saved = F.floor(F.col("__planned").cast("double") * share + 0.5).cast("bigint")
    return totals.withColumn("saved_bytes", saved).drop("__planned")


COUNTER_COLUMNS = [
    "moved_count", "deleted_count", "restored_count", "failed_count", "saved_bytes", "total_processed",
    "saved_bytes_exact",
]


def transaction_summary(transactions: DataFrame, actions: DataFrame) -> DataFrame:
    """Counters of every transaction, zero for those without actions."""
    joined = transactions.join(counters(actions), "transaction_id", "left")
    return joined.select(
        *transactions.columns, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTER_COLUMNS]
    )


def outcome_status(dry_run: Column, failed: Column) -> Column:
    """Any failure, even of every step, gives partially_completed."""
    return (
        F.when(dry_run, F.lit("pending")).when(failed == 0, F.lit("completed")).otherwise(F.lit("partially_completed"))
    )


PAGE = 10_000


ITEM = ("seq", "action_id", "type", "from_path", "to_path", "status", "error", "file_hash", "file_size")


def nested(transactions: DataFrame, actions: DataFrame, page_size: int = PAGE, fields: tuple[str, ...] = ITEM,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Transactions with their actions in order, as documents. The flat table stays the truth.

    A run may have any number of actions, so a document holds one page of them, page 0 first; ``seq``
    counts from 1 without gaps, so no array exceeds ``page_size``. ``fields``, ``seq`` first, are those of an action that are
    wanted. Where no run holds most actions, they are dealt out by transaction once, for the pages and for the join.
    """
    item = F.struct(*fields)
    if hot_keys(actions, ["transaction_id"], hot_rows) is None:
        actions = actions.select("transaction_id", *fields).repartition("transaction_id")
    page = F.floor((F.col("seq") - 1) / page_size).cast("bigint")
    lists = actions.groupBy("transaction_id", page.alias("page")).agg(F.array_sort(F.collect_list(item)).alias("actions"))
    return transactions.join(lists, "transaction_id", "left").withColumns({
        "page": F.coalesce("page", F.lit(0).cast("bigint")),
        "actions": F.coalesce("actions", F.array().cast(lists.schema["actions"].dataType)),
    })


def completed_actions(actions: DataFrame) -> DataFrame:
    return actions.filter("status = 'completed'")


def current_state(transactions: DataFrame, events: DataFrame) -> DataFrame:
    """Transactions with their newest status event applied."""
    newest = events.groupBy("transaction_id").agg(
        F.max_by(F.struct("status", "rolled_back_at", "rollback_transaction_id"), "event_seq").alias("e")
    )
    columns = [c for c in transactions.columns if c != "status"]
    return transactions.join(newest, "transaction_id", "left").select(
        *columns, F.coalesce("e.status", "status").alias("status"), "e.rolled_back_at", "e.rollback_transaction_id"
    )


def by_id(transactions: DataFrame, transaction_id: str) -> DataFrame:
    return transactions.filter(F.col("transaction_id") == transaction_id)


def newest_first(transactions: DataFrame) -> list[Column]:
    return [F.desc("created_at"), F.col("transaction_id")]


def recent(transactions: DataFrame, limit: int = 10, kind: str | None = None) -> DataFrame:
    rows = transactions if kind is None else transactions.filter(F.col("type") == kind)
    return rows.orderBy(*newest_first(rows)).limit(limit)


def can_roll_back() -> Column:
    return F.col("status").isin(*ROLLBACKABLE) & ~F.col("dry_run")


def rollbackable(transactions: DataFrame) -> DataFrame:
    rows = transactions.filter(can_roll_back())
    return rows.orderBy(*newest_first(rows))


def rollbackable_on_dashboard(transactions: DataFrame, loaded: int = 50, shown: int = 15) -> DataFrame:
    """The first rows of the newest transactions, each marked whether it offers a rollback."""
    rows = recent(recent(transactions, loaded), shown)
    return rows.withColumn("can_roll_back", can_roll_back() & (F.col("type") != "rollback"))


def rollback_history(transactions: DataFrame) -> DataFrame:
    rows = transactions.filter("type = 'rollback'")
    return rows.orderBy(*newest_first(rows))


def rollback_pairs(states: DataFrame) -> DataFrame:
    """Rolled-back transactions next to the rollback that closed them."""
    closed = states.filter("rollback_transaction_id IS NOT NULL").select(
        "transaction_id", "type", "rolled_back_at", "rollback_transaction_id"
    )
    closing = states.filter("type = 'rollback'").select(
        F.col("transaction_id").alias("rollback_transaction_id"), F.col("status").alias("rollback_status")
    )
    return closed.join(closing, "rollback_transaction_id")


def open_actions(actions: DataFrame, transactions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Completed actions of transactions that can be rolled back, balanced when one run holds most actions."""
    able = transactions.filter(can_roll_back()).select("transaction_id", F.lit(True).alias("__able"))
    found = lookup(completed_actions(actions), able, ["transaction_id"], F.col("from_path"), hot_rows)
    return found.filter("__able").drop("__able")


def current_files(records: DataFrame, actions: DataFrame, transactions: DataFrame) -> DataFrame:
    """The records of files that are there now, under the paths they have now.

    Completed moves, deletes and restores are followed from each file's path as scanned, in the order of their runs; a restore
    counts when its outcome says so. A deleted file stays out unless it is restored from where it was moved to. Each round
    takes all files one step further, so there are as many rounds as steps of the busiest file.
    """
    steps = cut_lineage(
        actions.filter("status = 'completed' AND (type IN ('move', 'delete') OR type = 'restore' AND outcome = 'restored')")
        .join(transactions.filter("NOT dry_run").select("transaction_id", F.col("created_at").alias("at")), "transaction_id")
        .select(F.col("from_path").alias("now"), F.struct("at", "transaction_id", "seq").alias("step"), "to_path", "type"), "steps",
    )
    columns = records.columns
    files = records.withColumn("now", F.col("file_path")).withColumn("gone", F.lit(False)).withColumn(
        "done", F.struct(F.col("created_at").alias("at"), F.lit("").alias("transaction_id"), F.lit(-1).cast("bigint").alias("seq")))
    files = files.withColumn("uid", F.monotonically_increasing_id())
    paths = cut_lineage(files.select("uid", "now", "gone", "done"), "paths")
    files = cut_lineage(files.drop("now", "gone", "done"), "files")
    left = paths
    settled = None
    written = [steps, paths]
    while not left.isEmpty():
        found = left.join(steps, "now", "left").filter("step IS NULL OR step > done")
        nxt = found.groupBy("uid").agg(F.min(F.struct("step", "to_path", "type")).alias("s"), F.count("step").alias("n")).filter("n > 0")
        moved = cut_lineage(left.join(nxt, "uid").select(
            "uid", F.col("s.to_path").alias("now"),
            F.when(F.col("s.type") == "delete", True).when(F.col("s.type") == "restore", False).otherwise(F.col("gone")).alias("gone"),
            F.col("s.step").alias("done")), "moved")
        stay = left.join(moved.select("uid"), "uid", "left_anti").select("uid", "now", "gone")
        settled = stay if settled is None else settled.union(stay)
        # Nothing follows a deletion for good; the blank path of all of them is never joined.
        left = moved.filter("NOT gone OR now <> ''")
        written.append(moved)
    if settled is None:
        return records
    kept = cut_lineage(settled.filter("NOT gone"), "kept")
    discard(*written)
    there = files.join(kept, "uid").withColumn("file_path", F.col("now")).withColumn("file_name", basename("now"))
    return there.select(*columns)
