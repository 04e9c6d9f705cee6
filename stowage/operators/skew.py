"""Lookups and ranks that stay balanced when one key holds a large share of the rows.

A key is *hot* when it has at least ``HOT_ROWS`` rows. At most ``HOT_KEYS`` hot keys are
treated, the largest first, so everything broadcast here has a fixed size bound; a key
beyond them holds less than 1/HOT_KEYS of the rows and needs no help. Which keys count as
hot changes only the plan, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.session import cut_lineage

HOT_ROWS = 1_000_000
HOT_KEYS = 4096
SAMPLE_FRACTION = 1 / 64
#: Ranges of a hot group hold about this share of ``hot_rows`` rows.
RANGE_SHARE = 4
#: A row of any table here takes at least so many bytes of a file.
ROW_BYTES = 32


def may_hold(df: DataFrame, hot_rows: int) -> bool:
    """Whether a key of the table could be hot, by the optimizer's estimate of its bytes; it costs no job.

    Like the number of hot keys, this only decides about the plan.
    """
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) >= hot_rows * ROW_BYTES


def largest_groups(counts: DataFrame, keys: list[str], size: str, hot_rows: int) -> DataFrame:
    """The at most ``HOT_KEYS`` largest groups with ``hot_rows`` rows or more."""
    return counts.filter(F.col(size) >= hot_rows).orderBy(F.desc(size), *keys).limit(HOT_KEYS)


def local_hot_keys(counts: DataFrame, keys: list[str], size: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Local table (keys, n) of the hot groups of a count table, or None when there are none."""
    top = largest_groups(counts, keys, size, hot_rows).select(*keys, F.col(size).cast("bigint").alias("n"))
    found = top.collect()  # at most HOT_KEYS rows
    return counts.sparkSession.createDataFrame(found, top.schema) if found else None


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Hot keys of any table, counted on a seeded sample of its key columns.

    Only these statistics are sampled, never results. A table too small for a hot key is not looked at.
    """
    if not may_hold(df, hot_rows):
        return None
    fraction = SAMPLE_FRACTION if hot_rows * SAMPLE_FRACTION >= 1000 else 1.0
    sample = df.select(*keys)
    if fraction < 1.0:
        sample = sample.sample(fraction=fraction, seed=11)
    counts = sample.groupBy(*keys).agg((F.count("*") / fraction).cast("bigint").alias("n"))
    return local_hot_keys(counts, keys, "n", hot_rows)


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: Column) -> DataFrame:
    """Left outer join to a right side that is unique on ``keys``.

    ``hot`` holds the same columns as ``right`` for the hot keys and is broadcast; its size is bounded
    by ``HOT_KEYS``. Rows it answers still pass the second join, but under a hash of their own as salt, which matches
    nothing there, so they are spread over all tasks. The salt of the right side is 0 for every row, in a form that
    the optimizer does not fold: folded, it would leave the exchange.
    """
    values = [c for c in right.columns if c not in keys]
    small = hot.select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__is_hot"))
    rows = left.join(F.broadcast(small), keys, "left").withColumn(
        "__salt",
        F.when(F.col("__is_hot"), F.pmod(F.xxhash64(spread), F.lit((1 << 62) - 1)) + 1).otherwise(F.lit(0).cast("bigint")),
    )
    zero = F.pmod(F.xxhash64(*keys), F.lit(1).cast("bigint"))
    joined = rows.join(right.withColumn("__salt", zero), [*keys, "__salt"], "left")
    chosen = [
        F.when(F.col("__is_hot"), F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in [*left.columns, *values]
    ]
    return joined.select(*chosen)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left outer join to a right side unique on ``keys``, balanced for hot keys of ``left``."""
    return lookup_with(left, right, keys, spread, hot_keys(left, keys, hot_rows))


def lookup_with(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, hot: DataFrame | None) -> DataFrame:
    """:func:`lookup` with hot keys that are known already."""
    if hot is None:
        return left.join(right, keys, "left")
    names = hot.select(*keys)
    answers = right.join(F.broadcast(names), keys, "inner")  # at most one row per hot key
    return salted_left_join(left, right, keys, names.join(F.broadcast(answers), keys, "left"), spread)


def rank_within(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``row_number`` per group, with hot groups cut into ranges of the order."""
    return rank_with(df, keys, order, name, hot_rows, hot_keys(df, keys, hot_rows))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def rank_with(
    df: DataFrame, keys: list[str], order: list[Column], name: str, hot_rows: int, hot: DataFrame | None
) -> DataFrame:
    """:func:`rank_within` with hot keys that are known already.

    The order must be total on distinct rows. The rows of hot groups are dealt out by ranges of key and order, as many
    as their number asks for; a range is one task, and its ranks are shifted by the rows of its key in the ranges before.
    """
    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))

    if hot is None:
        return plain(df)

    columns = df.columns
    df = cut_lineage(df, "ranks")  # read twice below
    busy = F.broadcast(hot.select(*keys))
    total = hot.agg(F.sum("n")).first()[0]
    ranges = max(2, -(-RANGE_SHARE * total // hot_rows))
    ordered = df.join(busy, _same(df, busy, keys), "left_semi").withColumn("__rank_order", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    dealt = cut_lineage(
        ordered.repartitionByRange(int(ranges), *keys, "__rank_order").withColumn("__bucket", F.spark_partition_id()), "ranges"
    )
    sizes = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.col("__bucket").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = dealt.withColumn("__local", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy("__rank_order")))
    ranked = local.join(offsets, _same(local, offsets, keys) & (F.col("__bucket") == F.col("__at"))).select(
        *[local[c] for c in columns], (F.col("__local") + F.col("__before")).cast("bigint").alias(name)
    )
    return plain(df.join(busy, _same(df, busy, keys), "left_anti")).unionByName(ranked)
