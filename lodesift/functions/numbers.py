"""Numeric parsing and rounding columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole_number(c: Column) -> Column:
    """Text to int: ``2010`` and ``2010.0`` count, fractions and junk are null."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def year_of(c: Column, date_format: str) -> Column:
    """Year of a date string, null when it does not parse."""
    return F.year(F.try_to_timestamp(c, F.lit(date_format))).cast("int")


def judge_score(raw: Column) -> Column:
    """First unsigned number of a judge reply, clamped to 0..1; none is 0."""
    number = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(\d+\.?\d*)", 1).try_cast("double")
    return F.coalesce(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def rounded(c: Column, decimals: int) -> Column:
    """Round to ``decimals``; negative zero becomes zero so that ties compare equal."""
    return F.round(c.cast("double"), decimals) + F.lit(0.0)
