"""Measured sizes: the check every broadcast goes through."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F, types as T

_ROW_OVERHEAD = 48
_FIXED = 16


@dataclass(frozen=True)
class Measure:
    rows: int
    bytes: int

    def blocks(self, limit: int) -> int:
        """How many pieces bring the bytes of each below half of ``limit``.

        Half, because hashing rows to pieces does not balance them exactly.
        """
        return max(1, ceil(2 * self.bytes / max(limit, 1)))


def _width(field: T.StructField):
    c = F.col(field.name)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.aggregate(
                F.coalesce(c, F.array()), F.lit(0).cast("long"),
                lambda acc, x: acc + F.coalesce(F.octet_length(x), F.lit(0)) + _FIXED,
            )
        return F.greatest(F.size(c), F.lit(0)).cast("long") * _FIXED
    return F.lit(_FIXED).cast("long")


def measure(df: DataFrame) -> Measure:
    """Exact row count and an upper estimate of the in-memory bytes of ``df``."""
    per_row = sum((_width(f) for f in df.schema.fields), F.lit(_ROW_OVERHEAD).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(per_row), F.lit(0)).alias("b")).first()
    return Measure(int(row["n"]), int(row["b"]))


def fits(df: DataFrame, limit: int) -> bool:
    return measure(df).bytes <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint where the measured size allows it, else ``df`` as it is.

    Without the hint Catalyst shuffles both sides and adaptive execution
    splits skewed partitions of the larger one.
    """
    return F.broadcast(df) if fits(df, limit) else df


def shard_of(key: str, shards: int | Column) -> Column:
    """Shard of a key: the folder of a stored table that holds its rows."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("int")


def in_shards(df: DataFrame, key: str, counts: list[int]) -> DataFrame:
    """``df`` with ``shards`` and ``shard``: a row for each number of shards that a stored table uses."""
    spread = df.withColumn("shards", F.explode(F.array(*[F.lit(n) for n in counts])))
    return spread.withColumn("shard", shard_of(key, F.col("shards")))
