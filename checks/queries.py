"""One query per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from stowage import functions as sf
from stowage.operators import clash_classes, validate_actions, validate_files, validate_transactions
from stowage.functions.categories import CATEGORIES
from stowage.plans import dedupe, documents, ledger, organize, report, rollback, scan
from stowage.plans import rollback_batch as rollback_batch_plan
from stowage.session import work_folder
from stowage.sources import CatalogueStore, hash_files, list_each, list_files, partial_hash_files
from stowage.streaming import ArrivalLog, activity_by_session, activity_by_window, first_arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# ---- sources and sinks ----

@query
def list_tree(spark, sf_dir):
    root = fx.document_tree(spark, sf_dir)
    found = list_files(spark, root)
    return found.select(F.substring("file_path", len(root) + 1, 1 << 20).alias("path"), "size")


@query
def list_flat(spark, sf_dir):
    """Not recursive: every folder that a document lies in, hidden ones too."""
    root = fx.document_tree(spark, sf_dir)
    folders = fx.tree_files(spark, sf_dir, root).select(sf.dirname("file_path").alias("file_path"))
    found, _ = list_each(folders)
    return found.select(F.substring("file_path", len(root) + 1, 1 << 20).alias("path"), "size")


@query
def listing_rules(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr(f"concat('/top', {fx.TREE_PATH}) AS file_path")
    return docs.filter(sf.listed("file_path", F.lit("/top")))


@query
def scan_errors(spark, sf_dir):
    """Asked for every written document and every page, which was never written."""
    root = fx.document_tree(spark, sf_dir)
    docs = fx.tree_files(spark, sf_dir, root).select("file_path", "size")
    pages = fx.page_paths(spark, sf_dir).withColumn("file_path", F.concat(F.lit(root), "file_path"))
    failed = hash_files(docs.unionByName(pages)).filter("error IS NOT NULL")
    return failed.select(F.substring("file_path", len(root) + 1, 1 << 20).alias("path"), "error").distinct()


@query
def normalize_path(spark, sf_dir):
    dirty = fx.listing(spark, sf_dir).select(
        "file_path",
        F.concat(F.lit("  "), F.regexp_replace("file_path", "/s(\\d+)/", "//s$1/./x/../"), F.lit("/ ")).alias("dirty"),
    )
    blank = fx.page_paths(spark, sf_dir).select("file_path", F.lit("   ").alias("dirty"))
    return dirty.unionByName(blank).select("file_path", sf.normalize_path("dirty", "/data/default").alias("clean"))


@query
def save_and_reload(spark, sf_dir):
    store = CatalogueStore(spark, work_folder(spark, "reload"))
    store.append("file_records", scan.file_records(fx.manifest(spark, sf_dir), fx.RUN_AT))
    return store.file_records().drop("file_created_at", "file_modified_at", "created_at", "updated_at")


@query
def ledger_current_state(spark, sf_dir):
    store = fx.ledger_store(spark, sf_dir)
    state = ledger.current_state(store.transactions(), store.status_events())
    return state.select("transaction_id", "type", "status", "rolled_back_at", "rollback_transaction_id")


@query
def report_json(spark, sf_dir):
    store = fx.records_store(spark, sf_dir)
    return report.report_json(store.file_records(), store.scans(), fx.ledger_store(spark, sf_dir).transactions())


@query
def catalogue_current(spark, sf_dir):
    """The files of all scans as four runs have left them."""
    records = fx.records_store(spark, sf_dir).file_records()
    heads, steps = fx.four_runs(records)
    return ledger.current_files(records, steps, heads).select("scan_id", "file_path", "file_name", "original_path")


@query
def scan_documents(spark, sf_dir):
    """In pages of 50 files."""
    store = fx.records_store(spark, sf_dir)
    return documents.scan_documents(store.scans(), store.file_records(), 50)


@query
def run_documents(spark, sf_dir):
    """In pages of 4 steps."""
    store = fx.ledger_store(spark, sf_dir)
    return documents.run_documents(store.transactions(), store.actions(), 4)


# ---- projections, filters, lookups ----

RECORD_COLUMNS = ["scan_id", "file_path", "hash", "extension", "category", "size", "is_duplicate", "duplicate_of"]
TX_COLUMNS = ["transaction_id", "type", "status", "dry_run", "created_at"]


@query
def manifest(spark, sf_dir):
    return fx.manifest(spark, sf_dir)


@query
def records_by_scan(spark, sf_dir):
    return scan.records_of_scan(fx.records_store(spark, sf_dir).file_records(), "fr").select(*RECORD_COLUMNS)


@query
def duplicates_by_scan(spark, sf_dir):
    return scan.duplicates_of_scan(fx.records_store(spark, sf_dir).file_records(), "en").select(*RECORD_COLUMNS)


SCAN_COLUMNS = ["scan_id", "scanned_path", "total_files", "total_size", "duplicates_count", "duplicates_size", "created_at"]


@query
def scan_by_id(spark, sf_dir):
    return scan.scan_by_id(fx.records_store(spark, sf_dir).scans(), "es").select(*SCAN_COLUMNS)


@query
def transaction_by_id(spark, sf_dir):
    return ledger.by_id(fx.ledger_store(spark, sf_dir).transactions(), "tx-7").select(*TX_COLUMNS)


@query
def rollbackable(spark, sf_dir):
    return ledger.rollbackable(fx.ledger_store(spark, sf_dir).transactions()).select(*TX_COLUMNS)


@query
def rollbackable_dashboard(spark, sf_dir):
    rows = ledger.rollbackable_on_dashboard(fx.ledger_store(spark, sf_dir).transactions())
    return rows.select(*TX_COLUMNS, "can_roll_back")


@query
def rollback_history(spark, sf_dir):
    return ledger.rollback_history(fx.ledger_store(spark, sf_dir).transactions()).select(*TX_COLUMNS)


@query
def recent_by_type(spark, sf_dir):
    return ledger.recent(fx.ledger_store(spark, sf_dir).transactions(), 10, "dedupe").select(*TX_COLUMNS)


@query
def recent_transactions_50(spark, sf_dir):
    return ledger.recent(fx.ledger_store(spark, sf_dir).transactions(), 50).select(*TX_COLUMNS)


@query
def organizable(spark, sf_dir):
    """Documents, plus the same files once moved into category folders: those must not come back."""
    loose = fx.manifest(spark, sf_dir)
    folder = F.concat(fx.root_of_scan(), F.lit("/x/"), "category", F.lit("/"), "file_name")
    both = loose.unionByName(loose.withColumn("file_path", folder))
    return organize.organizable(both, fx.root_of_scan(), recursive=True).select("scan_id", "file_path")


@query
def organizable_direct(spark, sf_dir):
    """Not recursive: only the direct children of a folder, here one per scan."""
    root = F.concat(fx.root_of_scan(), F.lit("/s1/b0"))
    return organize.organizable(fx.manifest(spark, sf_dir), root).select("scan_id", "file_path")


@query
def completed_actions(spark, sf_dir):
    return ledger.completed_actions(fx.ledger_store(spark, sf_dir).actions()).select(
        "transaction_id", "seq", "type", "from_path", "to_path", "file_size"
    )


@query
def validate_ledger(spark, sf_dir):
    """Counts per reason over ledger and file rows, some of them spoiled on purpose."""
    store = fx.ledger_store(spark, sf_dir)
    actions = store.actions().withColumn(
        "status", F.when(F.col("seq") % 7 == 0, F.lit("lost")).otherwise(F.col("status"))
    ).withColumn("from_path", F.when(F.col("seq") % 5 != 0, F.col("from_path")))
    headers = store.transactions().withColumn(
        "type", F.when(F.col("dry_run"), F.lit("purge")).otherwise(F.col("type"))
    )
    files = fx.manifest(spark, sf_dir).withColumn("hash", F.when(F.col("extension") != "", F.col("hash")))

    def reasons(rows, name):
        return rows.select(F.lit(name).alias("source"), "valid", F.array_join("reasons", ";").alias("reasons"))

    judged = reasons(validate_actions(actions), "actions").union(
        reasons(validate_transactions(headers), "transactions")
    ).union(reasons(validate_files(files), "files"))
    return judged.groupBy("source", "valid", "reasons").agg(F.count("*").alias("n"))


# ---- scan ----

@query
def categorize(spark, sf_dir):
    files = fx.listing(spark, sf_dir).select("file_path").union(fx.page_paths(spark, sf_dir).select("file_path"))
    return sf.with_category(files)


@query
def scan_flag_duplicates(spark, sf_dir):
    return scan.flag_duplicates(fx.listing(spark, sf_dir)).select(
        "scan_id", "file_path", "hash", "is_duplicate", "duplicate_of"
    )


@query
def scan_summary(spark, sf_dir):
    return scan.scan_summary(fx.listing(spark, sf_dir))


@query
def scan_categories(spark, sf_dir):
    return scan.categories_by_size(fx.manifest(spark, sf_dir))


@query
def duplicate_groups(spark, sf_dir):
    return scan.duplicate_groups(fx.listing(spark, sf_dir))


@query
def top_duplicate_groups(spark, sf_dir):
    return scan.top_duplicate_groups(scan.duplicate_groups(fx.listing(spark, sf_dir)))


@query
def directory_size(spark, sf_dir):
    return scan.directory_size(fx.listing(spark, sf_dir))


@query
def recent_scans(spark, sf_dir):
    return scan.recent_scans(fx.records_store(spark, sf_dir).scans()).select(*SCAN_COLUMNS)


@query
def recent_scans_20(spark, sf_dir):
    return scan.recent_scans(fx.records_store(spark, sf_dir).scans(), 20).select(*SCAN_COLUMNS)


@query
def latest_scan(spark, sf_dir):
    return scan.latest_scan(fx.records_store(spark, sf_dir).scans()).select(*SCAN_COLUMNS)


# ---- dedupe ----

REMOVAL_COLUMNS = ["scan_id", "hash", "file_path", "size", "kept_path"]


@query
def dedupe_latest(spark, sf_dir):
    return dedupe.removals(fx.listing(spark, sf_dir), "keep-latest").select(*REMOVAL_COLUMNS)


@query
def dedupe_oldest(spark, sf_dir):
    return dedupe.removals(fx.listing(spark, sf_dir), "keep-oldest").select(*REMOVAL_COLUMNS)


@query
def dedupe_largest(spark, sf_dir):
    return dedupe.removals(fx.listing(spark, sf_dir), "keep-largest").select(*REMOVAL_COLUMNS)


@query
def dedupe_ranked(spark, sf_dir):
    return dedupe.ranked_copies(fx.listing(spark, sf_dir)).select("scan_id", "hash", "file_path", "rank", "is_kept")


def _transaction() -> F.Column:
    return F.concat(F.lit("dedupe-"), "scan_id")


@query
def dedupe_actions(spark, sf_dir):
    """Planned deletions twice: into the trash, and for good."""
    doomed = dedupe.removals(fx.listing(spark, sf_dir))
    trashed = dedupe.delete_actions(doomed, _transaction(), fx.TRASH)
    final = dedupe.delete_actions(doomed, F.concat(F.lit("purge-"), "scan_id"), None)
    return trashed.unionByName(final).drop("error")


def _executed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Removals of the default strategy after a run in which installers were locked."""
    files = fx.listing(spark, sf_dir)
    doomed = dedupe.removals(files)
    planned = dedupe.delete_actions(doomed, _transaction(), fx.TRASH).withColumn(
        "scan_id", F.regexp_extract("transaction_id", "-(.*)$", 1)
    )
    locked = F.col("from_path").endswith(".exe")
    outcomes = planned.select(
        "transaction_id", "from_path", (~locked).alias("ok"), F.when(locked, F.lit("File is locked/busy")).alias("error"),
        F.lit(None).cast("string").alias("final_path"),
    )
    return files, ledger.record_outcomes(planned, outcomes, ["transaction_id", "from_path"])


@query
def dedupe_summary(spark, sf_dir):
    return dedupe.dedupe_summary(*_executed(spark, sf_dir))


@query
def dedupe_apply(spark, sf_dir):
    return dedupe.surviving_files(*_executed(spark, sf_dir)).select("scan_id", "file_path", "hash", "size")


@query
def saved_bytes(spark, sf_dir):
    """Proportional saving of every dedupe transaction, next to the bytes really deleted."""
    store = fx.ledger_store(spark, sf_dir)
    rows = ledger.transaction_summary(store.transactions().filter("type = 'dedupe'").drop("summary"), store.actions())
    return rows.select("transaction_id", "saved_bytes", "saved_bytes_exact")


@query
def dedupe_progressive(spark, sf_dir):
    root = fx.document_tree(spark, sf_dir)
    files = fx.tree_files(spark, sf_dir, root)
    read = dedupe.progressive_candidates(
        files, lambda rows: partial_hash_files(rows).drop("error"), lambda rows: hash_files(rows).drop("error")
    )
    doomed = dedupe.removals(read, "keep-latest")
    short = lambda name: F.substring(name, len(root) + 1, 1 << 20).alias(name)
    return doomed.select("scan_id", "hash", short("file_path"), "size", short("kept_path"))


@query
def trash_names(spark, sf_dir):
    """Names in the trash of everything the default strategy removes; the files of one scan lie there already."""
    files = fx.listing(spark, sf_dir)
    actions = dedupe.delete_actions(dedupe.removals(files), _transaction(), fx.TRASH)
    there = files.filter("scan_id = 'de'").select(
        F.concat(F.lit(f"{fx.TRASH}/{fx.RUN_MILLIS}_"), sf.basename("file_path")).alias("path")
    )
    return dedupe.trash_targets(actions, fx.TRASH, fx.RUN_MILLIS, there).select("from_path", "final_path")


# ---- organize ----

def _plan(spark, sf_dir) -> DataFrame:
    return organize.organize_plan(fx.manifest(spark, sf_dir), fx.root_of_scan(), recursive=True)


def _settled(spark, sf_dir) -> DataFrame:
    """Names already in the category folders: those of the first source folder of each scan."""
    early = fx.manifest(spark, sf_dir).filter("file_path LIKE '/data/%/s1/b0/%'")
    return early.select(F.concat(fx.root_of_scan(), F.lit("/"), "category", F.lit("/"), "file_name").alias("path"))


@query
def organize_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query
def organize_by_category(spark, sf_dir):
    return organize.by_category(_plan(spark, sf_dir))


@query
def plan_preview(spark, sf_dir):
    return organize.plan_preview(_plan(spark, sf_dir)).select("scan_id", "from_path", "to_path", "more")


@query
def organize_collision_fast(spark, sf_dir):
    rows = clash_classes(_plan(spark, sf_dir), _settled(spark, sf_dir), "to_path", sf.order_key("from_path"))
    return rows.select("from_path", "rank", "linked", "final_path")


@query
def organize_collision_exact(spark, sf_dir):
    return organize.resolved_moves(_plan(spark, sf_dir), _settled(spark, sf_dir)).select(
        "from_path", "final_path", "error"
    )


def _moves(spark, sf_dir) -> DataFrame:
    moves = organize.resolved_moves(_plan(spark, sf_dir), _settled(spark, sf_dir))
    return organize.move_actions(moves, F.concat(F.lit("organize-"), "scan_id"))


@query
def organize_apply(spark, sf_dir):
    return organize.moved_files(fx.manifest(spark, sf_dir), _moves(spark, sf_dir)).select(
        "scan_id", "file_path", "file_name", "original_path", "category"
    )


@query
def organize_summary(spark, sf_dir):
    rows = organize.organize_summary(_moves(spark, sf_dir))
    text = F.array_join(
        F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return rows.select("scan_id", "total_files", "moved_count", "failed_count", text.alias("by_category"))


# ---- ledger ----

@query
def ledger_nested(spark, sf_dir):
    store = fx.ledger_store(spark, sf_dir)
    rows = ledger.nested(store.transactions().select("transaction_id", "type"), store.actions(),
                         fields=("seq", "type", "from_path", "status"))
    text = F.transform("actions", lambda a: F.concat_ws(":", a["seq"].cast("string"), a["type"], a["status"], a["from_path"]))
    return rows.select("transaction_id", "type", "page", F.size("actions").cast("bigint").alias("n"),
                       F.array_join(text, ",").alias("actions"))


@query
def ledger_summary(spark, sf_dir):
    store = fx.ledger_store(spark, sf_dir)
    return ledger.transaction_summary(
        store.transactions().select("transaction_id", "type"), store.actions()
    )


@query
def ledger_status(spark, sf_dir):
    store = fx.ledger_store(spark, sf_dir)
    rows = ledger.transaction_summary(store.transactions().select("transaction_id", "dry_run"), store.actions())
    return rows.select("transaction_id", ledger.outcome_status(F.col("dry_run"), F.col("failed_count")).alias("status"))


@query
def record_outcomes(spark, sf_dir):
    """Every action planned anew; permanent deletes were not reached, failed ones keep their text."""
    actions = fx.ledger_store(spark, sf_dir).actions()
    planned = actions.withColumn("status", F.lit("pending"))
    happened = actions.filter("to_path <> ''").select(
        "transaction_id", "seq", (F.col("status") != "failed").alias("ok"), "error",
        F.when(F.col("seq") % 3 == 0, F.concat("to_path", F.lit(".1"))).alias("final_path"),
    )
    return ledger.record_outcomes(planned, happened, ["transaction_id", "seq"]).select(
        "transaction_id", "seq", "status", F.coalesce("error", F.lit("")).alias("error"), "to_path"
    )


@query
def error_reason(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_returnflag WHEN 'A' THEN 'EACCES' WHEN 'R' THEN 'EBUSY' ELSE "
        "CASE l_linestatus WHEN 'O' THEN 'ENOENT' ELSE 'EIO' END END AS code",
        "CASE WHEN l_linenumber = 1 THEN '' ELSE concat('error ', CAST(l_linenumber AS STRING)) END AS message",
    )
    return rows.groupBy("code", "message").agg(F.count("*").alias("n")).select(
        "code", "message", "n", ledger.error_reason("code", "message").alias("on_move"),
        ledger.error_reason("code", "message", move=False).alias("on_delete"),
    )


@query
def rollback_pairs(spark, sf_dir):
    store = fx.ledger_store(spark, sf_dir)
    return ledger.rollback_pairs(ledger.current_state(store.transactions(), store.status_events()))


@query
def present_paths(spark, sf_dir):
    return fx.present_paths(fx.ledger_store(spark, sf_dir).actions())


# ---- rollback ----

@query
def rollback_eligibility(spark, sf_dir):
    """Asked for one id per customer that exists and one that does not."""
    customers = fx.table(spark, sf_dir, "customer")
    asked = customers.select(F.concat(F.lit("tx-"), F.col("c_custkey").cast("string")).alias("transaction_id")).union(
        customers.select(F.concat(F.lit("cx-"), F.col("c_custkey").cast("string")))
    )
    return rollback.eligibility(asked, fx.ledger_store(spark, sf_dir).transactions()).select(
        "transaction_id", F.coalesce("reason", F.lit("")).alias("reason")
    )


def _open_actions(spark, sf_dir) -> DataFrame:
    store = fx.ledger_store(spark, sf_dir)
    return ledger.open_actions(store.actions(), store.transactions())


def _judged(spark, sf_dir) -> DataFrame:
    actions = fx.ledger_store(spark, sf_dir).actions()
    return rollback.outcomes(_open_actions(spark, sf_dir), fx.present_paths(actions))


@query
def rollback_plan(spark, sf_dir):
    return rollback.rollback_plan(_open_actions(spark, sf_dir)).select("transaction_id", "seq", "type", "from_path")


@query
def rollback_outcomes(spark, sf_dir):
    return _judged(spark, sf_dir).select(
        "transaction_id", "seq", "type", "outcome", F.coalesce("outcome_error", F.lit("")).alias("error")
    )


@query
def rollback_restored_paths(spark, sf_dir):
    """Names restored files get: place taken gives the first free name for deletes."""
    actions = fx.ledger_store(spark, sf_dir).actions()
    judged = _judged(spark, sf_dir).select("transaction_id", "seq", "type", "from_path", "outcome")
    paths = rollback.restored_paths(judged, fx.present_paths(actions))
    return paths.select("transaction_id", "seq", "final_path")


@query
def rollback_actions(spark, sf_dir):
    rows = rollback.rollback_actions(_judged(spark, sf_dir), F.concat(F.lit("undo-"), "transaction_id"))
    return rows.select("transaction_id", "seq", "type", "from_path", "to_path", "status", "outcome", "file_size",
                       F.coalesce("error", F.lit("")).alias("error"))


@query
def rollback_summary(spark, sf_dir):
    return rollback.rollback_summary(_judged(spark, sf_dir))


@query
def rollback_nonrestored(spark, sf_dir):
    return rollback.not_restored(_judged(spark, sf_dir)).select(
        "transaction_id", "seq", "outcome", F.col("outcome_error").alias("error"), "more"
    )


@query
def rollback_batch(spark, sf_dir):
    """All open transactions undone one after another, newest first, on paths that many of them share."""
    steps, present = fx.shared_steps(_open_actions(spark, sf_dir))
    newest_first = fx.ledger_store(spark, sf_dir).transactions().selectExpr(
        "transaction_id", "CAST(substring(transaction_id, 4) AS BIGINT) - unix_date(CAST(created_at AS DATE)) * 10000000000 AS place")
    shown = steps.select("transaction_id", "seq", "type", "status", "from_path", "to_path")
    judged = rollback_batch_plan.outcomes_in_order(shown, newest_first, present)
    return judged.select("transaction_id", "seq", "from_path", "to_path", "outcome", F.coalesce("outcome_error", F.lit("")).alias("error"),
                         F.coalesce("final_path", F.lit("")).alias("final_path"))


# ---- report ----

def _stores(spark, sf_dir):
    store = fx.records_store(spark, sf_dir)
    return store.file_records(), store.scans()


@query
def report_overview(spark, sf_dir):
    return report.overview(*_stores(spark, sf_dir), fx.ledger_store(spark, sf_dir).transactions())


@query
def report_space_saved(spark, sf_dir):
    return report.space_saved(fx.ledger_store(spark, sf_dir).transactions())


@query
def report_category_breakdown(spark, sf_dir):
    return report.category_breakdown(fx.records_store(spark, sf_dir).scans())


@query
def report_extension_stats(spark, sf_dir):
    return report.extension_stats(*_stores(spark, sf_dir))


@query
def report_duplicate_stats(spark, sf_dir):
    return report.duplicate_stats(*_stores(spark, sf_dir))


@query
def report_top_dup_ext(spark, sf_dir):
    return report.top_duplicated_extensions(*_stores(spark, sf_dir))


@query
def report_recent_scans(spark, sf_dir):
    return report.recent_scan_rows(fx.records_store(spark, sf_dir).scans())


@query
def report_recent_activity(spark, sf_dir):
    return report.recent_activity(fx.ledger_store(spark, sf_dir).transactions())


# ---- scalar functions ----

@query
def file_extension(spark, sf_dir):
    """Names built from every event type and part, with dots in all places."""
    parts = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("b"), F.col("p_name").alias("n"))
    shapes = ["{n}", ".{n}", "{n}.", "{n}.TAR.gz", "..{b}", "/my.dir/{b}", "/d/{b} x.Md"]
    names = F.array(*[
        F.regexp_replace(F.regexp_replace(F.lit(s), r"\{n\}", F.col("n")), r"\{b\}", F.col("b")) for s in shapes
    ])
    rows = parts.select(F.explode(names).alias("path")).distinct()
    return rows.select("path", sf.extension("path").alias("extension"))


@query
def category_dim(spark, sf_dir):
    """The eight categories in display order with the documents and bytes in each."""
    used = fx.manifest(spark, sf_dir).groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    return sf.category_dim(spark).join(used, "category", "left").select(
        "position", "category", "extensions", F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("size", F.lit(0)).alias("size"),
    )


@query
def extensions_for_category(spark, sf_dir):
    """Extensions of every category with the documents that carry each."""
    used = fx.manifest(spark, sf_dir).groupBy("extension").agg(F.count("*").alias("files"))
    every = reduce(DataFrame.union, [
        sf.extensions_for_category(spark, c).withColumn("category", F.lit(c)) for c in CATEGORIES if c != "Others"
    ])
    return every.join(used, "extension", "left").select("category", "extension", F.coalesce("files", F.lit(0)).alias("files"))


@query
def format_bytes(spark, sf_dir):
    """Sizes from bytes to beyond petabytes, spread over the units by powers of ten and two."""
    sizes = fx.table(spark, sf_dir, "documents").select(F.octet_length("text").cast("bigint").alias("n"))
    wide = sizes.select(F.explode(F.array(
        F.lit(0).cast("bigint"), F.col("n"), F.col("n") * 1000, F.shiftleft(F.col("n"), 17), F.col("n") * 10**9,
        F.col("n") * 10**12,
    )).alias("bytes")).distinct()
    return wide.select("bytes", sf.format_bytes("bytes").alias("text"))


@query
def full_hash(spark, sf_dir):
    """Content hash of every document as a column and as a file read in chunks."""
    root = fx.document_tree(spark, sf_dir)
    docs = fx.table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"concat('{root}', {fx.TREE_PATH}) AS file_path",
                                                           "CAST(octet_length(text) AS BIGINT) AS size")
    read = hash_files(docs.select("doc_id", "file_path", "size"))
    return docs.select("doc_id", sf.full_hash("text").alias("of_column")).join(
        read.select("doc_id", F.col("hash").alias("of_file")), "doc_id"
    )


@query
def partial_hash(spark, sf_dir):
    root = fx.document_tree(spark, sf_dir)
    docs = fx.table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"concat('{root}', {fx.TREE_PATH}) AS file_path",
                                                           "CAST(octet_length(text) AS BIGINT) AS size")
    read = partial_hash_files(docs.select("doc_id", "file_path", "size"))
    return docs.select("doc_id", sf.partial_hash("text").alias("of_column")).join(
        read.select("doc_id", F.col("partial_hash").alias("of_file")), "doc_id"
    )


@query
def path_parts(spark, sf_dir):
    paths = fx.listing(spark, sf_dir).select("file_path").union(fx.page_paths(spark, sf_dir).select("file_path"))
    return paths.select(
        "file_path", sf.basename("file_path").alias("name"), sf.dirname("file_path").alias("folder"),
        sf.parent_name("file_path").alias("parent"), sf.stem(sf.basename("file_path")).alias("stem"),
        sf.join_path(F.lit("/root"), sf.basename("file_path")).alias("joined"),
    )


# ---- streaming ----

@query
def stream_duplicates(spark, sf_dir):
    """Documents as a stream of files; each with its original, the first that arrived with its content."""
    schema = fx.table(spark, sf_dir, "documents").schema
    # A pattern with one match takes a file as well as a folder.
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/document[s].parquet")
    rows = docs.selectExpr(
        "lang AS scan_id", "sha2(text, 256) AS hash", f"{fx.DOCUMENT_PATH} AS file_path",
        "CAST(octet_length(text) AS BIGINT) AS size",
        "timestampadd(SECOND, (doc_id * 7919) % 86400, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS arrived_at",
    )
    log = ArrivalLog(spark, work_folder(spark, "stream"))
    first_arrivals(rows, log).trigger(availableNow=True).start().awaitTermination()
    return log.rows().select("scan_id", "hash", "file_path", "is_duplicate", "duplicate_of")


def _times(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query
def activity_tumbling(spark, sf_dir):
    rows = activity_by_window(fx.activity(fx.table(spark, sf_dir, "events")))
    return _times(rows, "window_start", "window_end")


@query
def activity_sliding(spark, sf_dir):
    rows = activity_by_window(fx.activity(fx.table(spark, sf_dir, "events")), "6 hours", "1 hour")
    return _times(rows, "window_start", "window_end")


@query
def activity_session(spark, sf_dir):
    rows = activity_by_session(fx.activity(fx.table(spark, sf_dir, "events")))
    return _times(rows, "session_start", "session_end")
