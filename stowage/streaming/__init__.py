"""Incremental jobs on Structured Streaming."""

from stowage.streaming.activity import ActivityLog, activity_by_session, activity_by_window, activity_with_late_rows, late_rows_dropped
from stowage.streaming.arrivals import ArrivalLog, first_arrivals
from stowage.streaming.duplicates import duplicate_group_stream, first_arrival_stream, resolve_originals

__all__ = [
    "ActivityLog", "ArrivalLog", "activity_by_session", "activity_by_window", "activity_with_late_rows", "duplicate_group_stream", "first_arrival_stream", "first_arrivals",
    "late_rows_dropped", "resolve_originals",
]
