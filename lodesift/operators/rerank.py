"""Pair scoring of candidates and the cut to the final hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import RetrievalConfig, SizeLimits
from ..functions.numbers import rounded
from ..functions.text import tokens
from .sizing import broadcast_if_small

PairModel = Callable[[list[str], list[str]], np.ndarray]


def overlap_weights(
    queries: DataFrame, terms: DataFrame, n_docs: int, limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """Per query its distinct terms with ``ln(1 + N / (1 + df))``, as one array.

    The array is as long as the query; unknown terms have df 0.  The vocabulary
    is cut to the asked terms where it lies, before the outer join.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    wanted = broadcast_if_small(asked.select("term"), limits.broadcast_bytes)
    known = terms.select("term", "df").join(wanted, "term", "left_semi")
    weighted = asked.join(known, "term", "left").select(
        "query_id", F.struct(
            "term", F.ln(1 + F.lit(n_docs) / (1 + F.coalesce("df", F.lit(0)))).alias("weight")
        ).alias("entry"),
    )
    return weighted.groupBy("query_id").agg(F.sort_array(F.collect_list("entry")).alias("query_weights"))


def overlap_score(query_weights: Column, doc_tokens: Column, decimals: int = RetrievalConfig.decimals) -> Column:
    """Share of the query's term weight that the document covers, in 0..1."""
    total = F.aggregate(query_weights, F.lit(0.0), lambda acc, e: acc + e["weight"])
    found = F.aggregate(
        query_weights, F.lit(0.0),
        lambda acc, e: acc + F.when(F.array_contains(doc_tokens, e["term"]), e["weight"]).otherwise(0.0),
    )
    return F.when(total > 0, rounded(found / total, decimals)).otherwise(F.lit(0.0))


def model_scores(pairs: DataFrame, model: PairModel, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """Score pairs with an injected model, in Arrow batches: adds ``rerank_score``."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = model(batch[query_col].fillna("").tolist(), batch[text_col].fillna("").tolist())
                yield batch.assign(rerank_score=np.asarray(scores, dtype=np.float64))

    return pairs.mapInPandas(run, schema)


def split_by_need(candidates: DataFrame, top_k: int) -> DataFrame:
    """Flag queries whose candidates outnumber ``top_k``: only those are rescored."""
    return candidates.withColumn(
        "needs_rerank", F.count(F.lit(1)).over(Window.partitionBy("query_id")) > top_k
    )


def cut(scored: DataFrame, top_k: int) -> DataFrame:
    """Best ``top_k`` by rerank score, earlier rank first on ties.

    Queries that were not rescored (null score) keep their fused order.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("fused_rank"))
    return (
        scored.withColumnRenamed("rank", "fused_rank")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
    )


def query_scores(hits: DataFrame, decimals: int = RetrievalConfig.decimals) -> DataFrame:
    """``query_id, best_score, mean_score, n_docs``; 1.0 where nothing was rescored."""
    return hits.groupBy("query_id").agg(
        F.coalesce(F.max("rerank_score"), F.lit(1.0)).alias("best_score"),
        rounded(F.coalesce(F.avg("rerank_score"), F.lit(1.0)), decimals).alias("mean_score"),
        F.count(F.lit(1)).alias("n_docs"),
    )
