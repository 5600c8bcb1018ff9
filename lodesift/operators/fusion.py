"""Weighted reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..config import RetrievalConfig
from ..functions.numbers import rounded


def ranked_list(hits: DataFrame, list_id: int) -> DataFrame:
    """``query_id, list_id, rank, doc_id, score`` of one best-first list.

    Lists that carry a rank keep it; others are ranked by score, then document.
    """
    if "rank" not in hits.columns:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
        hits = hits.withColumn("rank", F.row_number().over(order))
    return hits.select("query_id", F.lit(list_id).alias("list_id"), "rank", "doc_id", "score")


def fuse(
    lists: list[DataFrame], weights: list[float] | None = None, k: int = RetrievalConfig.rrf_k,
    top_k: int = RetrievalConfig.candidates, decimals: int = 9,
) -> DataFrame:
    """Merge ranked lists: ``query_id, doc_id, rrf_score, rank``.

    Scores add up over lists, and over repeats inside a list.  Ties keep the
    order of first appearance: list by list, rank by rank.
    """
    weights = [1.0] * len(lists) if weights is None else list(weights)
    if len(weights) != len(lists):
        raise ValueError(f"{len(weights)} weights for {len(lists)} lists")
    entries = reduce(DataFrame.unionByName, [
        ranked_list(hits, n).withColumn("part", F.lit(float(w)) / (F.lit(float(k)) + F.col("rank")))
        for n, (hits, w) in enumerate(zip(lists, weights))
    ])
    merged = entries.groupBy("query_id", "doc_id").agg(
        rounded(F.sum("part"), decimals).alias("rrf_score"),
        F.min(F.struct("list_id", "rank")).alias("first_seen"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("first_seen"))
    return (
        merged.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
        .select("query_id", "doc_id", "rrf_score", "rank")
    )
