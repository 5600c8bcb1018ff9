"""External search results as hits, and the approval filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import AnswerConfig


def external_hits(rows: DataFrame, limit: int = AnswerConfig.external_results) -> DataFrame:
    """Rows ``query_id, idx, title, url, content, score`` in the shape of hits.

    ``idx`` is the position in the result list, from 0; the first ``limit``
    results of each query are taken.
    """
    order = Window.partitionBy("query_id").orderBy("idx")
    return (
        rows.withColumn("n", F.row_number().over(order) - 1).filter(F.col("n") < limit)
        .select(
            "query_id",
            F.col("n").cast("int").alias("idx"),
            F.concat(F.lit("web_"), F.col("n").cast("string")).alias("doc_id"),
            F.coalesce("content", F.lit("")).alias("text"),
            F.create_map(
                F.lit("source"), F.lit("web"), F.lit("url"), F.coalesce("url", F.lit("")),
                F.lit("title"), F.coalesce("title", F.lit("")),
            ).alias("metadata"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
            F.lit("low").alias("confidence"),
            F.lit(True).alias("web_searched"),
        )
    )


def review_items(hits: DataFrame, chars: int = 200) -> DataFrame:
    """What a reviewer gets to see: position, title, link and the start of the text."""
    title: Column = F.when(F.col("metadata")["title"] != "", F.col("metadata")["title"]).otherwise(
        F.concat(F.lit("Result "), (F.col("idx") + 1).cast("string"))
    )
    return hits.select(
        "query_id", "idx", title.alias("title"), F.col("metadata")["url"].alias("url"),
        F.substring("text", 1, chars).alias("snippet"),
    )


def keep_approved(hits: DataFrame, approvals: DataFrame | None) -> DataFrame:
    """Hits whose position was approved.

    ``approvals`` has ``query_id, idx``; a row with a null ``idx`` approves all
    hits of its query, and so does ``None`` for the whole table.  A query
    without any row keeps nothing.
    """
    if approvals is None:
        return hits
    everything = approvals.filter(F.col("idx").isNull()).select("query_id").distinct()
    chosen = approvals.filter(F.col("idx").isNotNull()).select("query_id", F.col("idx").cast("int").alias("idx"))
    whole = hits.join(everything, "query_id", "left_semi")
    return whole.unionByName(
        hits.join(everything, "query_id", "left_anti").join(chosen, ["query_id", "idx"], "left_semi")
    )
