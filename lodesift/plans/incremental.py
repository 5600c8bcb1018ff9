"""Snapshots one at a time: deduplication that touches only the keys of the new snapshot.

The folder holds ``winners`` (a narrow row per key and change: key, place,
batch), ``rows`` (the wide rows that won when they came) and ``replaced`` (places
of rows that have lost since).  Adding a snapshot reads the stored winners of
its own keys and no wide row of earlier snapshots; the earliest place wins, so
snapshots may also come late.  The current table is all rows but the replaced
ones: the same as one run over all snapshots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import STARTUP_COLUMNS, SizeLimits
from ..operators.sizing import broadcast_if_small
from ..session import materialise

_KEY = ("source", "key_name", "key_year")


def _key() -> list[Column]:
    """The key of deduplication, without nulls: a missing year equals a missing year."""
    return [F.col("source"), F.lower("name").alias("key_name"), F.coalesce(F.col("founded_year"), F.lit(-(2**31))).alias("key_year")]


@dataclass(frozen=True)
class IncrementalCatalogue:
    """A cleaned catalogue that grows by snapshots; labels name the writes, so a repeated one replaces itself."""

    spark: SparkSession
    path: str
    limits: SizeLimits = SizeLimits()

    def _table(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _read(self, name: str, without: str | None = None) -> DataFrame | None:
        """One table over all finished snapshots, or None before the first."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._table("done"))
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        labels = [r["label"] for r in self.spark.read.parquet(self._table("done")).select("label").collect() if r["label"] != without]
        if not labels:
            return None
        base = self._table(name)
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/snapshot={label}" for label in labels])

    def add(self, cleaned: DataFrame, label: str) -> DataFrame:
        """Add a cleaned snapshot (unified columns, ``ordinal``; one row per key) and return its update set.

        The set has the winning rows with ``change``: ``new``, or ``replaced``
        where the key had a later row before.
        """
        cleaned = materialise(cleaned.select(*STARTUP_COLUMNS, "ordinal"), "snapshot")
        keys = cleaned.select(*_key(), F.col("ordinal").alias("place"))
        known = self._read("winners", without=label)
        if known is None:
            changed = keys.withColumn("before", F.lit(None).cast(cleaned.schema["ordinal"].dataType))
        else:
            # Stored winners of the new keys only: narrow rows, met by a measured set of keys.
            asked = broadcast_if_small(keys.select(*_KEY), self.limits.broadcast_bytes)
            old = known.join(asked, list(_KEY), "left_semi").groupBy(*_KEY).agg(F.min("place").alias("before"))
            changed = keys.join(old, list(_KEY), "left").filter(F.col("before").isNull() | (F.col("place") < F.col("before")))
        changed = materialise(changed, "changed")
        won = cleaned.join(broadcast_if_small(changed.select("source", F.col("place").alias("ordinal"), "before"), self.limits.broadcast_bytes), ["source", "ordinal"])
        self._write(changed.drop("before"), "winners", label)
        self._write(won.drop("before"), "rows", label)
        self._write(changed.filter(F.col("before").isNotNull()).select("source", F.col("before").alias("ordinal")), "replaced", label)
        self._write(self.spark.range(1).select(F.lit(label).alias("label")), "done", label)
        stored = self.spark.read.schema(won.drop("before").schema).parquet(f"{self._table('rows')}/snapshot={label}")
        changes = changed.select("source", F.col("place").alias("ordinal"), F.when(F.col("before").isNull(), "new").otherwise("replaced").alias("change"))
        return stored.join(broadcast_if_small(changes, self.limits.broadcast_bytes), ["source", "ordinal"])

    def _write(self, df: DataFrame, name: str, label: str) -> None:
        df.write.mode("overwrite").parquet(f"{self._table(name)}/snapshot={label}")

    def current(self) -> DataFrame:
        """The unified table after all snapshots so far."""
        rows, gone = self._read("rows"), self._read("replaced")
        if rows is None:
            raise ValueError(f"no snapshot at {self.path}")
        gone = broadcast_if_small(gone.select("source", "ordinal"), self.limits.broadcast_bytes)
        return rows.join(gone, ["source", "ordinal"], "left_anti").select(*STARTUP_COLUMNS, "ordinal")
