"""Row, byte and error counts of a running job, without a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def with_progress(df: DataFrame, size: Column | str | None = None, failed: Column | None = None,
                  name: str = "progress") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation with ``rows``, ``bytes`` and ``errors`` once an action has run."""
    watch = Observation(name)
    size = F.col(size) if isinstance(size, str) else size
    metrics = [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(size) if size is not None else F.lit(None), F.lit(0)).cast("bigint").alias("bytes"),
        (F.count_if(failed) if failed is not None else F.sum(F.lit(0))).cast("bigint").alias("errors"),
    ]
    return df.observe(watch, *metrics), watch
