"""Vector columns in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalise(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """L2-normalise a vector column; the zero vector stays zero.

    The norm is a column of its own, so it is computed once per row and not
    once per element.
    """
    length = f"__norm_{column}"
    unit = F.transform(
        as_double(F.col(column)),
        lambda x: F.when(F.col(length) == 0, F.lit(0.0)).otherwise(x / F.col(length)),
    )
    return df.withColumn(length, norm(F.col(column))).withColumn(out or column, unit).drop(length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )
