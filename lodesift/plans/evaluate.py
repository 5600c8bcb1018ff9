"""Evaluation of answers against a table of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import AnswerConfig
from ..functions.numbers import judge_score
from ..functions.text import preview, token_estimate
from ..operators import inference as inf
from ..operators import prompts
from ..operators.metrics import bad_result_check, precision_at_k, structure_score
from ..session import materialise
from .answer import answer_queries, documents_text
from .index import Index

_DOC_SEPARATOR = "\n---\n"


def judge(scored: DataFrame, models: inf.Models, first: int = 5) -> DataFrame:
    """Add the three judged metrics and ``judge_failed``; the judge sees the ``first`` documents.

    A failed or unreadable reply scores 0, as usual; ``judge_failed`` tells it
    from an honest 0.
    """
    query, answer = F.col("query"), F.coalesce("answer", F.lit(""))
    docs = documents_text(F.col("docs"), first, _DOC_SEPARATOR)
    metrics = {
        "context_relevancy": (
            prompts.render(prompts.JUDGE_CONTEXT, query=query, documents=docs),
            inf.score_text(inf.token_coverage(query, docs)),
        ),
        "groundedness": (
            prompts.render(prompts.JUDGE_GROUNDED, documents=docs, answer=answer),
            inf.score_text(inf.token_coverage(answer, docs)),
        ),
        "answer_relevancy": (
            prompts.render(prompts.JUDGE_ANSWER, query=query, answer=answer, type=F.col("analysis_type")),
            inf.score_text(inf.token_coverage(query, answer)),
        ),
    }
    failed = F.lit(False)
    for name, (prompt, default) in metrics.items():
        raw = f"__{name}"
        scored = inf.with_reply(scored, raw, models.judge, prompt, default, store=models.store)
        failed = failed | F.col(f"{raw}_error").isNotNull() | ~F.coalesce(F.col(raw), F.lit("")).rlike(r"\d")
    scored = scored.withColumn("judge_failed", failed)
    for name in metrics:
        scored = scored.withColumn(name, F.round(judge_score(F.col(f"__{name}")), 3))
    return scored.drop(*[c for n in metrics for c in (f"__{n}", f"__{n}_error")])


def score_results(
    items: DataFrame, results: DataFrame, models: inf.Models = inf.Models(), model_name: str | None = None,
) -> DataFrame:
    """Items joined with their answers, one evaluation row each.

    ``items``: id, query, analysis_type, expected_domains, bad_results,
    expected_sections, description.  ``results``: id, answer, docs, error,
    latency_seconds.  Items without a result and failed ones carry an
    ``error`` and null metrics.
    """
    joined = items.join(results.withColumn("__found", F.lit(True)), "id", "left").withColumn(
        "error", F.when(F.col("__found").isNull(), "no result").otherwise(F.col("error"))
    )
    good = judge(joined.filter(F.col("error").isNull()), models)
    texts = F.transform("docs", lambda d: d["text"])
    answer = F.coalesce("answer", F.lit(""))
    good = good.select(
        "id", "query", "analysis_type", F.lit(model_name).cast("string").alias("model_name"), "description",
        preview(answer, 200).alias("answer_preview"),
        F.size("docs").alias("num_sources"),
        "context_relevancy", "groundedness", "answer_relevancy",
        F.round(precision_at_k(texts, F.col("expected_domains")), 3).alias("precision_at_k"),
        F.round(structure_score(answer, F.col("expected_sections")), 3).alias("structure_score"),
        bad_result_check(texts, F.col("bad_results")).alias("bad_result_check"),
        F.round("latency_seconds", 2).alias("latency_seconds"),
        token_estimate(answer).cast("long").alias("total_tokens"),
        "judge_failed", F.lit(None).cast("string").alias("error"),
    )
    bad = joined.filter(F.col("error").isNotNull()).select("id", "query", "analysis_type", "error")
    return good.unionByName(bad, allowMissingColumns=True)


def evaluate(
    items: DataFrame, index: Index, cfg: AnswerConfig = AnswerConfig(), *, models: inf.Models = inf.Models(),
    model_name: str | None = None, **options,
) -> DataFrame:
    """Answer all items and score them.

    Answering is a batch job, so there is no latency of a single query; the
    column is null unless a caller adds one.
    """
    queries = items.select(F.col("id").alias("query_id"), F.col("query").alias("text"))
    answered = answer_queries(queries, index, cfg, models=models, **options)
    results = answered.select(
        F.col("query_id").alias("id"), "answer", "docs", "error", F.lit(None).cast("double").alias("latency_seconds")
    )
    scored = score_results(items, results, models, model_name)
    return materialise(scored, "evaluated") if models.judge else scored
