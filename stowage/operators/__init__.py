"""Reusable DataFrame operators: skew-safe lookup and ranking, keep-one, name clashes, validation."""

from stowage.operators.collisions import clash_classes, resolve_names
from stowage.operators.keepone import STRATEGIES, attach_kept, kept_files, keep_order
from stowage.operators.skew import lookup, rank_within
from stowage.operators.topk import first_rows, one_row
from stowage.operators.validate import validate_actions, validate_files, validate_transactions

__all__ = [
    "STRATEGIES", "attach_kept", "clash_classes", "first_rows", "keep_order", "kept_files", "lookup", "one_row", "rank_within",
    "resolve_names", "validate_actions", "validate_files", "validate_transactions",
]
