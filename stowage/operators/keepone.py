"""Which copy of a group of equal files is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.paths import from_order_key, order_key
from stowage.operators.skew import HOT_ROWS, hot_keys, lookup_with

GROUP = ["scan_id", "hash"]
_LATE = (1 << 63) - 1

# Strategy name to the value that decides; the smallest wins and walk order breaks ties.
# Files of one group have one size, so "keep-largest" always falls through to walk order.
STRATEGIES = {
    "keep-latest": lambda: -_micros("file_modified_at"),
    "keep-oldest": lambda: _micros("file_created_at"),
    "keep-largest": lambda: -F.col("size"),
}


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def keep_order(strategy: str) -> list[Column]:
    """Sort columns of a strategy. A file without a time never beats one with a time."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}; use one of {', '.join(STRATEGIES)}")
    return [F.coalesce(STRATEGIES[strategy](), F.lit(_LATE)), order_key("file_path")]


def kept_files(files: DataFrame, strategy: str = "keep-oldest", keys: list[str] = GROUP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per group of two or more: copies, bytes, the kept path and its size.

    Without hot groups it is one shuffle and one window over it. With them, counts and the deciding number come first, numbers only, combined
    on the map side; paths are looked at by the rows of groups with copies that have that number, of which every task hands on one
    for each group.
    """
    return _kept(files, strategy, keys, hot_keys(files, keys, hot_rows))


def _kept(files: DataFrame, strategy: str, keys: list[str], hot: DataFrame | None) -> DataFrame:
    first, walk = keep_order(strategy)
    rows = files.select(*keys, first.alias("__first"), walk.alias("__walk"), "size")
    group = Window.partitionBy(*keys)
    if hot is None:
        place = F.row_number().over(group.orderBy("__first", "__walk", "size"))
        ranked = rows.withColumns({"copies": F.count("*").over(group), "total_size": F.sum("size").over(group), "__place": place})
        kept = ranked.filter("__place = 1 AND copies > 1")
    else:
        groups = rows.groupBy(*keys).agg(
            F.count("*").alias("copies"), F.sum("size").alias("total_size"), F.min("__first").alias("__least")
        ).filter("copies > 1")
        members = lookup_with(rows, groups, keys, F.col("__walk"), hot).filter("__first = __least")
        kept = members.withColumn("__place", F.row_number().over(group.orderBy("__walk", "size"))).filter("__place = 1")
    return kept.select(*keys, "copies", "total_size", from_order_key("__walk").alias("kept_path"), F.col("size").alias("kept_size"))


def attach_kept(files: DataFrame, strategy: str, keys: list[str] = GROUP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every file with ``kept_path`` of its group, null when it has no copy. One shuffle when no group is hot."""
    hot = hot_keys(files, keys, hot_rows)
    if hot is not None:
        return lookup_with(files, _kept(files, strategy, keys, hot).select(*keys, "kept_path"), keys, F.col("file_path"), hot)
    group = Window.partitionBy(*keys)
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    kept = F.first("file_path").over(group.orderBy(*keep_order(strategy)))
    return files.withColumn("kept_path", F.when(there & (F.count("*").over(group) > 1), kept))


def with_copies(files: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The files whose key occurs at least twice. Only keys are counted, and only the keys that pass meet the rows, so that a broadcast or
    a runtime Bloom filter of them can keep the others from the shuffle."""
    groups = files.groupBy(*keys).agg(F.count("*").alias("__copies")).filter("__copies > 1")
    hot = hot_keys(files, keys, hot_rows)
    if hot is None:
        return files.join(groups.select(*keys), keys, "left_semi").select(*files.columns)
    return lookup_with(files, groups, keys, F.col("file_path"), hot).filter("__copies IS NOT NULL").drop("__copies")
