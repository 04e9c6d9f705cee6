"""Number formats and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit names, each 1024 times the one before.
UNITS = ("Bytes", "KB", "MB", "GB", "TB", "PB")


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Whole-number percent, 0 when the whole is 0."""
    share = part.cast("double") / whole.cast("double") * 100
    return F.when(whole > 0, round_half_up(share)).otherwise(F.lit(0).cast("bigint"))


def default_count(value: Column | str) -> Column:
    return F.coalesce(value, F.lit(0)).cast("bigint")


def label_extension(extension: Column | str) -> Column:
    return F.coalesce(F.nullif(F.col(extension) if isinstance(extension, str) else extension, F.lit("")),
                      F.lit("No extension"))


def as_json(rows: DataFrame, name: str = "value") -> DataFrame:
    """Every row as one JSON text."""
    return rows.select(F.to_json(F.struct("*")).alias(name))


def format_bytes(size: Column | str, decimals: int = 2) -> Column:
    """``1536`` becomes ``1.5 KB``. Exact arithmetic, so halves round up exactly; units end at PB.

    A fraction of a unit has at most 50 binary and so 50 decimal places; ``decimals`` may be any number. The digits come in
    groups of three from the rest of the division before, which keeps each step inside 64 bits.
    """
    size = (F.col(size) if isinstance(size, str) else size).cast("bigint")
    places = max(0, decimals)

    def in_unit(index: int) -> Column:
        bits = 10 * index
        unit = F.lit(1 << bits).cast("bigint")
        mask = F.lit((1 << bits) - 1).cast("bigint")
        rest, left, groups = size.bitwiseAND(mask), places, []
        while left > 0:
            step = min(3, left)
            scaled = rest * F.lit(10**step).cast("bigint")
            groups.append((F.shiftright(scaled, bits), step))
            rest, left = scaled.bitwiseAND(mask), left - step
        carry = (rest * 2 >= unit).cast("bigint")
        digits = []
        for value, step in reversed(groups):
            value = value + carry
            carry = F.floor(value / 10**step).cast("bigint")
            digits.append(F.lpad((value % 10**step).cast("string"), step, "0"))
        whole = (F.shiftright(size, bits) + carry).cast("string")
        text = F.regexp_replace(F.concat(whole, F.lit("."), *reversed(digits)), r"\.?0+$", "") if places else whole
        return F.concat(text, F.lit(" " + UNITS[index]))

    result = F.when(size == 0, F.lit("0 Bytes"))
    for index in range(len(UNITS) - 1):
        result = result.when(size < (1 << (10 * (index + 1))), in_unit(index))
    return result.otherwise(in_unit(len(UNITS) - 1))
