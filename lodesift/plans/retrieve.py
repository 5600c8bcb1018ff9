"""Hybrid retrieval for a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import RetrievalConfig, SizeLimits
from ..functions.rules import confidence_band
from ..functions.text import tokens
from ..operators.blocks import BlockSearch
from ..operators.cells import nearest_coded
from ..operators.clean import computed_once
from ..operators.documents import where as apply_where
from ..operators.embed import embed
from ..operators.fusion import fuse
from ..operators.nearest import best_first, nearest
from ..operators.rerank import PairModel, cut, model_scores, overlap_score, overlap_weights, query_scores, split_by_need
from ..operators.sizing import broadcast_if_small, in_shards, measure
from ..session import materialise
from .index import Index


def semantic_list(
    queries: DataFrame, index: Index, k: int, where: dict[str, object] | None = None,
    cfg: RetrievalConfig = RetrievalConfig(), limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """Cosine list of each query: exact, or over cells and codes with ``cfg.approximate`` where the index has them."""
    # Stored once: its size is measured before it is used, and the model runs once per query.
    embedded = materialise(
        embed(queries.select("query_id", "text"), index.encoder).select("query_id", "embedding"), "query-vectors"
    )
    if not cfg.approximate or not index.coded:
        return nearest(index.vectors, embedded, k, where=where, decimals=cfg.decimals, limits=limits)
    # Every batch has cells of its own; the filter goes before the codes.
    lists = [
        nearest_coded(apply_where(rows, where), embedded, codes, k, probes=probes, rescore=rescore, decimals=cfg.decimals, limits=limits).drop("scored")
        for rows, codes, probes, rescore in index.coded
    ]
    if index.plain_vectors is not None:
        lists.append(nearest(index.plain_vectors, embedded, k, where=where, decimals=cfg.decimals, limits=limits))
    return lists[0] if len(lists) == 1 else best_first(reduce(DataFrame.unionByName, lists).drop("rank"), k)


def lexical_list(
    queries: DataFrame, index: Index, k: int, where: dict[str, object] | None = None,
    cfg: RetrievalConfig = RetrievalConfig(), limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    return BlockSearch(
        index.postings, index.chunks, queries, index.terms, index.corpus, k, cfg=cfg.lexical, decimals=cfg.decimals, limits=limits, where=where,
    ).hits()


def candidate_list(
    queries: DataFrame, index: Index, cfg: RetrievalConfig = RetrievalConfig(),
    where: dict[str, object] | None = None, filter_lexical: bool = True, limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """``query_id, doc_id, rank`` of the candidates before the final cut."""
    wide = cfg.candidates if (cfg.rerank or cfg.hybrid) else cfg.top_k
    semantic = semantic_list(queries, index, wide, where, cfg, limits)
    if not cfg.hybrid:
        return semantic.select("query_id", "doc_id", "score", "rank")
    lexical = lexical_list(
        queries, index, cfg.lexical.top_k, where if filter_lexical else None, cfg, limits
    )
    fused = fuse([semantic, lexical], [cfg.semantic_weight, cfg.lexical_weight], cfg.rrf_k, cfg.candidates)
    return fused.withColumnRenamed("rrf_score", "score")


def hybrid_hits(
    queries: DataFrame, index: Index, cfg: RetrievalConfig = RetrievalConfig(), *,
    where: dict[str, object] | None = None, filter_lexical: bool = True, pair_model: PairModel | None = None,
    limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """Final hits: ``query_id, rank, doc_id, text, score, rerank_score``.

    ``queries`` has ``query_id, text``.  Only queries with more candidates than
    ``top_k`` are rescored; for the others ``rerank_score`` is null and the
    candidate order stands.
    """
    candidates = candidate_list(queries, index, cfg, where, filter_lexical, limits)
    if not cfg.rerank:
        kept = candidates.filter(F.col("rank") <= cfg.top_k).withColumn("rerank_score", F.lit(None).cast("double"))
        return _with_text(kept, queries, index, cfg, limits).select(
            "query_id", "rank", "doc_id", "text", "score", "rerank_score"
        )
    pairs = _with_text(split_by_need(candidates, cfg.top_k), queries, index, cfg, limits)
    if pair_model is None:
        weights = overlap_weights(queries, index.terms, index.corpus.n_docs, limits)
        # Once per pair: inside the lambda of the score it would be repeated per query term.
        scored = (
            computed_once(pairs, {"doc_tokens": F.array_distinct(tokens("text"))})
            .join(weights, "query_id", "left")
            .withColumn("rerank_score", F.when(F.col("needs_rerank"), F.coalesce(
                overlap_score(F.col("query_weights"), F.col("doc_tokens"), cfg.decimals), F.lit(0.0)
            )))
            .drop("doc_tokens", "query_weights")
        )
    else:
        asked = pairs.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        rescored = model_scores(asked.filter("needs_rerank"), pair_model)
        kept = asked.filter(~F.col("needs_rerank")).withColumn("rerank_score", F.lit(None).cast("double"))
        scored = rescored.unionByName(kept).drop("query")
    return cut(scored, cfg.top_k).select("query_id", "rank", "doc_id", "text", "score", "rerank_score")


def _with_text(
    candidates: DataFrame, queries: DataFrame, index: Index, cfg: RetrievalConfig, limits: SizeLimits,
) -> DataFrame:
    """Texts of the candidates; ids without a document are dropped.

    The lists are cut already, so the candidates are few and are written once
    and measured.  They go to where the texts are; beyond the limit, their ids
    alone (a row per document, however many queries ask for it) pick the texts
    before those are shuffled.
    """
    candidates = materialise(candidates, "candidates")
    keys = ["doc_id"]
    if index.document_shards:
        # Stored documents lie in folders by shard; the join reads only those asked for.
        keys = ["shards", "shard", "doc_id"]
        # True for every rank, but Spark prunes at run time only by a side with a filter.
        candidates = in_shards(candidates.filter("rank > 0"), "doc_id", index.document_shards)
    texts = index.documents.select(*keys, "text")
    if measure(candidates).bytes <= limits.broadcast_bytes:
        return texts.join(F.broadcast(candidates), keys).drop("shards", "shard")
    asked = broadcast_if_small(candidates.select(*keys).distinct(), limits.broadcast_bytes)
    return texts.join(asked, keys, "left_semi").join(candidates, keys).drop("shards", "shard")


def retrieval_results(queries: DataFrame, hits: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """One row per query: ``docs`` in rank order, scores and confidence.

    Queries without hits stay, with an empty array and confidence ``none``.
    """
    entry = F.struct("rank", "doc_id", "text", "score", "rerank_score")
    docs = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("docs"))
    joined = (
        queries.join(docs, "query_id", "left")
        .join(query_scores(hits, cfg.decimals), "query_id", "left")
    )
    empty = F.array().cast(docs.schema["docs"].dataType)
    n_docs = F.coalesce("n_docs", F.lit(0))
    best = F.coalesce("best_score", F.lit(1.0))
    return joined.select(
        *queries.columns, F.coalesce("docs", empty).alias("docs"), n_docs.cast("int").alias("n_docs"),
        best.alias("best_score"), F.coalesce("mean_score", F.lit(1.0)).alias("mean_score"),
        confidence_band(best, n_docs, cfg).alias("confidence"),
    )


def retrieve(queries: DataFrame, index: Index, cfg: RetrievalConfig = RetrievalConfig(), **options) -> DataFrame:
    """:func:`hybrid_hits` folded to one row per query."""
    return retrieval_results(queries, hybrid_hits(queries, index, cfg, **options), cfg)
