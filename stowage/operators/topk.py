"""First rows of an ordered table together with the number of rows left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows and a column ``more`` with the count of the others.

    The count travels as one extra row, so nothing is joined and the last window sees limit + 1 rows.
    """
    shown = rows.orderBy(*order).limit(limit).withColumn("__shown", F.lit(True))
    total = rows.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more"))
    both = shown.unionByName(total, allowMissingColumns=True)
    return (
        both.withColumn("more", F.max("more").over(Window.partitionBy(F.lit(1))))
        .filter("__shown")
        .select(*rows.columns, "more")
    )


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Columns of several one-row tables side by side, as a union and one aggregate."""
    columns = [c for part in parts for c in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.any_value(c, ignoreNulls=True).alias(c) for c in columns])
