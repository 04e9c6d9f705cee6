"""Table layouts and the closed sets of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed sets of the ledger columns.
TRANSACTION_TYPES = ("organize", "dedupe", "rollback")
TRANSACTION_STATUSES = ("pending", "completed", "partially_completed", "failed", "rolled_back")
ACTION_TYPES = ("move", "delete", "restore")
ACTION_STATUSES = ("pending", "completed", "failed", "rolled_back")

SUMMARY_FIELDS = ("moved_count", "deleted_count", "restored_count", "failed_count", "saved_bytes", "total_processed")


_NAMES = {
    "string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """Fields from "name type" pairs; ``nested`` gives the types that are not plain names."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, nested.get(name) or _NAMES[kind]) for name, kind in pairs])


_CATEGORY_TOTALS = T.MapType(T.StringType(), _struct("count bigint, size bigint"))
_SUMMARY = _struct(", ".join(f"{name} bigint" for name in SUMMARY_FIELDS))

LISTING = _struct(
    "scan_id string, file_path string, size bigint, "
    "file_created_at timestamp_ntz, file_modified_at timestamp_ntz, hash string"
)

FILE_RECORDS = _struct(
    "file_name string, file_path string, original_path string, hash string, extension string, category string, "
    "size bigint, is_duplicate boolean, duplicate_of string, file_created_at timestamp_ntz, "
    "file_modified_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, scan_id string"
)

SCANS = _struct(
    "scan_id string, scanned_path string, total_files bigint, total_size bigint, duplicates_count bigint, "
    "duplicates_size bigint, categories map, created_at timestamp_ntz, updated_at timestamp_ntz",
    categories=_CATEGORY_TOTALS,
)

SCAN_ERRORS = _struct("scan_id string, file_path string, error string")

TRANSACTIONS = _struct(
    "transaction_id string, scan_id string, type string, status string, summary struct, target_path string, "
    "dry_run boolean, strategy string, created_at timestamp_ntz, completed_at timestamp_ntz",
    summary=_SUMMARY,
)

ACTIONS = _struct(
    "transaction_id string, seq bigint, action_id string, type string, from_path string, to_path string, "
    "status string, error string, file_hash string, file_size bigint, outcome string"
)

STATUS_EVENTS = _struct(
    "transaction_id string, event_seq bigint, status string, rolled_back_at timestamp_ntz, "
    "rollback_transaction_id string"
)
