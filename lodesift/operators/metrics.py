"""Evaluation metrics and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import REPORT_TYPES
from ..functions.numbers import rounded
from ..functions.text import contains_any

CORE = ["context_relevancy", "groundedness", "answer_relevancy"]
METRICS = [*CORE, "precision_at_k", "structure_score", "bad_result_check"]
PASS_MARK = 0.70


def precision_at_k(texts: Column, keywords: Column) -> Column:
    """Share of texts that contain any keyword; 0 without texts or keywords."""
    hits = F.size(F.filter(texts, lambda t: contains_any(t, keywords)))
    return F.when((F.size(texts) > 0) & (F.size(keywords) > 0), hits / F.size(texts)).otherwise(F.lit(0.0))


def structure_score(answer: Column, sections: Column) -> Column:
    """Share of expected headings found in the answer; 1 if none is expected."""
    lowered = F.lower(F.coalesce(answer, F.lit("")))
    hits = F.size(F.filter(sections, lambda s: F.contains(lowered, F.lower(s))))
    return F.when(F.size(sections) > 0, hits / F.size(sections)).otherwise(F.lit(1.0))


def bad_result_check(texts: Column, unwanted: Column) -> Column:
    """1 when no unwanted phrase occurs in the texts joined by spaces, else 0."""
    return F.when(contains_any(F.array_join(texts, " "), unwanted), F.lit(0.0)).otherwise(F.lit(1.0))


def joined_texts(hits: DataFrame, separator: str = "\n\n---\n\n", first: int | None = None) -> DataFrame:
    """``query_id, documents``: hit texts in rank order as one text."""
    if first is not None:
        hits = hits.filter(F.col("rank") <= first)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return hits.groupBy("query_id").agg(F.array_join(ordered, separator).alias("documents"))


def _average(name: str, decimals: int = 3) -> Column:
    return F.round(F.avg(F.when(F.col("error").isNull(), F.col(name))), decimals).alias(f"avg_{name}")


def _summary_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.round(F.sum(F.col("latency_seconds")), 1).alias("total_time_seconds"),
        _average("latency_seconds", 2),
        *[_average(m) for m in METRICS],
    ]


def run_summary(results: DataFrame) -> DataFrame:
    """Overall averages over successful rows; ``error`` set when all failed."""
    return results.agg(*_summary_columns()).withColumn(
        "error", F.when(F.col("successful") == 0, "All queries failed")
    )


def summary_by_type(results: DataFrame) -> DataFrame:
    """Averages per analysis type, absent types left out, in report order."""
    order = F.create_map(*[F.lit(x) for n, t in enumerate(REPORT_TYPES) for x in (t, n)])
    names = ["context_relevancy", "groundedness", "answer_relevancy", "precision_at_k"]
    scored = results.filter(F.col("error").isNull() & F.col("analysis_type").isin(REPORT_TYPES))
    return (
        scored.groupBy("analysis_type").agg(F.count(F.lit(1)).alias("count"), *[_average(n) for n in names])
        .orderBy(F.try_element_at(order, F.col("analysis_type")))
    )


def summary_rollup(results: DataFrame) -> DataFrame:
    """Overall and per-type summary in one pass; the overall row is type ``all``."""
    return results.rollup("analysis_type").agg(*_summary_columns()).withColumn(
        "analysis_type", F.coalesce("analysis_type", F.lit("all"))
    )


def latency_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    return results.groupBy(*(by or [])).agg(
        F.round(F.avg("latency_seconds"), 3).alias("avg_latency"),
        F.min("latency_seconds").alias("min_latency"),
        F.max("latency_seconds").alias("max_latency"),
    )


def pass_table(results: DataFrame, mark: float = PASS_MARK) -> DataFrame:
    """Composite of the core metrics and pass flag per scored query, weakest first."""
    composite = sum((F.col(m) for m in CORE[1:]), F.col(CORE[0])) / len(CORE)
    passed = F.lit(True)
    for m in CORE:
        passed = passed & (F.col(m) >= mark)
    return (
        results.filter(F.col("error").isNull())
        .select("id", "analysis_type", *METRICS, rounded(composite, 2).alias("avg_core"), passed.alias("passed"))
        .orderBy("avg_core", "id")
    )


def pass_rate(results: DataFrame, by: list[str] | None = None, mark: float = PASS_MARK) -> DataFrame:
    passed = F.lit(True)
    for m in CORE:
        passed = passed & (F.col(m) >= mark)
    composite = sum((F.col(m) for m in CORE[1:]), F.col(CORE[0])) / len(CORE)
    return results.filter(F.col("error").isNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(passed).alias("passed"),
        rounded(F.avg(passed.cast("double")), 4).alias("pass_rate"),
        rounded(F.avg(composite), 4).alias("avg_core"),
    )


def metric_matrix(results: DataFrame, long: bool = True) -> DataFrame:
    """Query x metric, one row per pair (long) or per query (wide)."""
    wide = results.filter(F.col("error").isNull()).select("id", *METRICS)
    return wide.unpivot("id", METRICS, "metric", "score") if long else wide


def compare_runs(results: DataFrame, run_col: str = "run") -> DataFrame:
    """One summary row per run."""
    return results.groupBy(run_col).agg(*_summary_columns())


def share_of_total(counts: DataFrame, column: str = "count", out: str = "share", decimals: int = 6) -> DataFrame:
    """Share of each row in the sum; for tables that are already aggregated."""
    total = F.sum(column).over(Window.partitionBy())
    return counts.withColumn(out, rounded(F.col(column) / total, decimals))
