"""Is every name of a watch list in the table?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SizeLimits
from .automaton import mentions
from .sizing import broadcast_if_small


def watch_coverage(
    df: DataFrame, watch: DataFrame, order_by: str = "ordinal", limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """``watch(name)`` against ``df(name, …)``: exact, partial or not found.

    Names compare without case.  An exact match wins over a substring match;
    within a kind the first row in ``order_by`` wins.  Every distinct name is
    walked once by an automaton of the watch list.
    """
    firsts = (
        df.filter(F.col("name").isNotNull()).groupBy(F.lower("name").alias("lowered"))
        .agg(F.min_by(F.struct("name", "source"), order_by).alias("row"), F.min(order_by).alias("first"))
    )
    wanted = watch.select(F.col("name").alias("watch_name")).distinct().withColumn("wanted", F.lower("watch_name"))
    wanted = wanted.filter(F.length("wanted") > 0)
    pieces = mentions(firsts, "lowered", wanted.select(F.col("wanted").alias("word")), limits).withColumnRenamed("word", "wanted")
    small = broadcast_if_small(wanted, limits.broadcast_bytes)
    kind = F.when(F.col("lowered") == F.col("wanted"), 0).otherwise(1)
    matches = (
        pieces.join(small, "wanted")
        .groupBy("watch_name").agg(F.min(F.struct(kind.alias("kind"), "first", "row")).alias("best"))
    )
    return wanted.join(matches, "watch_name", "left").select(
        "watch_name",
        F.when(F.col("best").isNull(), "missing").when(F.col("best.kind") == 0, "exact").otherwise("partial")
        .alias("status"),
        F.col("best.row.name").alias("matched_name"),
        F.col("best.row.source").alias("source"),
    )
