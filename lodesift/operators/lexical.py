"""BM25 over token tables.

Term frequencies, document frequencies and scores are plain aggregates.  The
postings are spread by document: the score of a (query, document) pair then
needs no further shuffle, and a term that occurs in every document is as evenly
spread as the documents are.  Per task only ``k`` hits of each query leave.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LexicalConfig, RetrievalConfig, SizeLimits
from ..functions.numbers import rounded
from ..functions.text import tokens
from ..session import materialise
from .nearest import best_first
from .sizing import measure

#: Postings, and (question, document) pairs scored from them, of a task; and the most tasks, beyond which Spark spills.
TASK_ROWS, MOST_TASKS = 1 << 19, 20_000


def tokenise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by its tokens and the token count."""
    return docs.select("doc_id", tokens(text_col).alias("tokens")).withColumn("doc_len", F.size("tokens"))


def term_statistics(docs: DataFrame) -> DataFrame:
    """``term, df, docs, length``: one pass over the corpus.

    ``docs`` and ``length`` carry the number of documents and their tokens on
    the first distinct term of each document (a null term for documents without
    tokens), so that summing them over the table gives the corpus totals
    without reading the corpus again.
    """
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    return (
        tokenise(docs)
        .select("doc_len", F.posexplode_outer(F.array_distinct("tokens")).alias("pos", "term"))
        .select(
            "term",
            F.when(first, 1).otherwise(0).cast("long").alias("docs"),
            F.when(first, F.col("doc_len")).otherwise(0).cast("long").alias("length"),
        )
        .groupBy("term")
        .agg(F.count("term").alias("df"), F.sum("docs").alias("docs"), F.sum("length").alias("length"))
    )


def raw_idf(n_docs: Column, df: Column) -> Column:
    return F.ln(n_docs - df + 0.5) - F.ln(df + 0.5)


@dataclass(frozen=True)
class Corpus:
    """Corpus totals: the one row every score depends on."""

    n_docs: int
    total_length: int
    n_terms: int
    avgdl: float
    avg_idf: float


def corpus_statistics(terms: DataFrame) -> DataFrame:
    """One row with the columns of :class:`Corpus`.

    The average runs over the raw idf of the whole vocabulary, negative ones
    included.  Equal document frequencies are folded first, so the last step
    sees one row per distinct frequency.
    """
    n_docs = terms.agg(F.sum("docs")).scalar()
    folded = terms.groupBy("df").agg(
        F.count("term").alias("n"), F.sum("docs").alias("docs"), F.sum("length").alias("length")
    )
    idf_sum = F.sum(F.when(F.col("df") > 0, raw_idf(n_docs, F.col("df")) * F.col("n")))
    return folded.agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"),
        F.coalesce(F.try_divide(F.sum("length"), F.sum("docs")), F.lit(0.0)).alias("avgdl"),
        F.coalesce(F.try_divide(idf_sum, F.sum("n")), F.lit(0.0)).alias("avg_idf"),
    )


def read_corpus(stats: DataFrame) -> Corpus:
    return Corpus(**stats.first().asDict())


def idf(df: Column, corpus: Corpus, cfg: LexicalConfig = LexicalConfig()) -> Column:
    """Inverse document frequency; negative values become epsilon x average."""
    raw = raw_idf(F.lit(corpus.n_docs), df)
    return F.when(raw < 0, F.lit(cfg.epsilon * corpus.avg_idf)).otherwise(raw)


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf`` from ``query_id, text``; repeats are counted."""
    return (
        queries.select("query_id", F.explode(tokens("text")).alias("term"))
        .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


def postings(docs: DataFrame, only_terms: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``doc_id, doc_len, term, tf``, spread by document in a single shuffle; over ``tasks`` tasks, or as adaptive execution sees fit."""
    # The outer form: for a plain explode Spark infers a filter on the array and
    # evaluates the token pattern a second time to test it.
    exploded = (
        tokenise(docs).select("doc_id", "doc_len", F.explode_outer("tokens").alias("term"))
        .filter(F.col("term").isNotNull())
    )
    if only_terms is not None:
        exploded = exploded.join(only_terms, "term", "left_semi")
    return (
        exploded.repartition(*([tasks] if tasks else []), "doc_id")
        .groupBy("doc_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def score_postings(
    posting: DataFrame, weights: DataFrame, corpus: Corpus, k: int, *,
    cfg: LexicalConfig = LexicalConfig(), decimals: int = RetrievalConfig.decimals,
) -> DataFrame:
    """Top-k hits of ``weights(query_id, term, weight)`` over postings.

    The score is rounded before ranking; documents that do not score above
    zero are no hits.
    """
    tf = F.col("tf").cast("double")
    saturation = tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * F.col("doc_len") / F.lit(corpus.avgdl)))
    scored = (
        posting.withColumn("saturation", saturation)
        .join(weights, "term")
        .groupBy("doc_id", "query_id")
        .agg(F.sum(F.col("weight") * F.col("saturation")).alias("score"))
        .filter(F.col("score") > 0)
        .select("query_id", "doc_id", rounded(F.col("score"), decimals).alias("score"))
    )
    return best_first(scored, k)


def tasks_for(asked: DataFrame, terms: DataFrame, n_docs: int) -> int:
    """Tasks that keep the postings of the asked terms and the pairs they score below ``TASK_ROWS`` each.

    Adaptive execution sizes tasks by the bytes they read: tokens.  What they hold is
    a row for each question that a document shares a term with, which is far more.
    """
    asking = asked.groupBy("term").agg(F.count(F.lit(1)).alias("asking"))
    found = terms.select("term", "df").join(F.broadcast(asking), "term").agg(
        F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.sum(F.col("df") * F.col("asking")), F.lit(0)).alias("matches"),
    ).first()
    pairs = min(found["matches"], n_docs * asked.select("query_id").distinct().count())
    least = asked.sparkSession.sparkContext.defaultParallelism
    return max(least, min(ceil((found["postings"] + pairs) / TASK_ROWS), MOST_TASKS))


def search_postings(
    posting: Callable[[DataFrame, int], DataFrame], queries: DataFrame, terms: DataFrame, corpus: Corpus, k: int, *,
    cfg: LexicalConfig = LexicalConfig(), decimals: int = RetrievalConfig.decimals, limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """BM25 for a table of queries.

    ``posting`` gives the postings of a set of terms, spread by document over a
    number of tasks: :func:`postings` from texts.  The query side is broadcast when its measured size
    allows it; otherwise the queries are cut into blocks that do, and each
    block is answered on its own: a query is in exactly one block, so its top k
    is final.
    """
    asked = materialise(query_terms(queries), "query-terms")
    # Bounds the broadcast tables before any corpus work: one row per query term.
    blocks = measure(asked).blocks(limits.broadcast_bytes)

    def answer(part: DataFrame) -> DataFrame:
        wanted = F.broadcast(part.select("term"))
        table = posting(wanted, tasks_for(part, terms, corpus.n_docs))
        weights = terms.select("term", "df").join(F.broadcast(part), "term").select(
            "query_id", "term", (idf(F.col("df"), corpus, cfg) * F.col("qtf")).alias("weight")
        )
        return score_postings(table, F.broadcast(weights), corpus, k, cfg=cfg, decimals=decimals)

    if blocks == 1:
        return answer(asked)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [answer(asked.filter(block == n)) for n in range(blocks)])


def bm25_search(
    docs: DataFrame, queries: DataFrame, k: int = LexicalConfig.top_k, *,
    terms: DataFrame | None = None, cfg: LexicalConfig = LexicalConfig(),
    decimals: int = RetrievalConfig.decimals, limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """BM25 top-k straight from texts: ``query_id, doc_id, score, rank``.

    Reads the corpus twice: for the vocabulary, which is written to the shared
    folder, and for the postings of the asked terms.
    """
    terms = materialise(term_statistics(docs), "terms") if terms is None else terms
    return search_postings(
        lambda wanted, tasks: postings(docs, wanted, tasks), queries, terms, read_corpus(corpus_statistics(terms)), k,
        cfg=cfg, decimals=decimals, limits=limits,
    )
