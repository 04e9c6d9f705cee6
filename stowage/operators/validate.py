"""Required columns and closed sets, as one pass that keeps every row with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.schemas import ACTION_STATUSES, ACTION_TYPES, TRANSACTION_STATUSES, TRANSACTION_TYPES


def _missing(name: str) -> Column:
    blank = F.col(name).isNull() | (F.col(name) == "")
    return F.when(blank, F.lit(f"{name} missing"))


def _outside(name: str, allowed: tuple[str, ...]) -> Column:
    return F.when(~F.col(name).isin(*allowed), F.lit(f"{name} not allowed"))


def _judge(df: DataFrame, checks: list[Column]) -> DataFrame:
    """Add ``reasons`` (array) and ``valid``; split with ``filter(valid)`` and ``filter(~valid)``."""
    return df.withColumn("reasons", F.array_compact(F.array(*checks))).withColumn("valid", F.size("reasons") == 0)


def validate_actions(actions: DataFrame) -> DataFrame:
    return _judge(actions, [
        _missing("action_id"), _missing("type"), _outside("type", ACTION_TYPES),
        _missing("from_path"), _outside("status", ACTION_STATUSES),
    ])


def validate_transactions(transactions: DataFrame) -> DataFrame:
    return _judge(transactions, [
        _missing("transaction_id"), _missing("type"), _outside("type", TRANSACTION_TYPES),
        _outside("status", TRANSACTION_STATUSES), _missing("target_path"),
    ])


def validate_files(files: DataFrame) -> DataFrame:
    required = ("scan_id", "file_name", "file_path", "original_path", "hash", "category")
    return _judge(files, [_missing(name) for name in required])
