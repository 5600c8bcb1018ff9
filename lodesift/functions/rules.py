"""Decision columns: record quality, confidence, routing, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import ANALYSIS_TYPES, PLACEHOLDER_NAMES, CleanConfig, RetrievalConfig
from .text import strip


def quality_rules(as_of_year: Column, cfg: CleanConfig = CleanConfig()) -> dict[str, Column]:
    """The five rules that make a record suspicious, by name."""
    name = F.coalesce(F.col("name"), F.lit(""))
    year = F.col("founded_year")
    return {
        "short_name": F.length(name) < cfg.short_name,
        "short_description": F.length(F.coalesce(F.col("description"), F.lit(""))) < cfg.short_description,
        "placeholder_name": name.rlike(f"(?i){PLACEHOLDER_NAMES}"),
        "year_too_old": year < cfg.oldest_year,
        "year_in_future": year > as_of_year + cfg.future_years,
    }


def confidence_band(best: Column, n_docs: Column, cfg: RetrievalConfig = RetrievalConfig()) -> Column:
    """``none``/``low``/``high`` from the best score; nothing found is ``none``."""
    band = F.when(n_docs == 0, "none")
    if not cfg.guardrails:
        return band.otherwise("high")
    return (
        band.when(best < cfg.hard_threshold, "none")
        .when(best < cfg.soft_threshold, "low")
        .otherwise("high")
    )


def generation_step(analysis_type: Column) -> Column:
    return F.concat(F.lit("generate_"), analysis_type)


def step_after_confidence(
    confidence: Column, retries: Column, analysis_type: Column, max_retries: int, external: bool,
) -> Column:
    return (
        F.when(confidence.isin("high", "low"), generation_step(analysis_type))
        .when(retries < max_retries, "rewrite")
        .otherwise("web_search" if external else "refuse")
    )


def step_after_validation(passed: Column, confidence: Column, retries: Column, max_retries: int) -> Column:
    retry = ~passed & (confidence != "low") & (retries < max_retries)
    return F.when(retry, "rewrite").otherwise("end")


def analysis_type(raw: Column) -> Column:
    """A classifier reply as a known type; unknown, empty or failed is ``similar``."""
    label = F.lower(strip(raw))
    return F.when(label.isin(*ANALYSIS_TYPES), label).otherwise("similar")


def verdict(n_docs: Column, best: Column, raw: Column, error: Column) -> Column:
    """Validation outcome: documents, a positive score, then the literal ``pass``.

    A failed call counts as a pass, like an unavailable checker.
    """
    return (
        F.when(n_docs == 0, False)
        .when(best <= 0, False)
        .when(error.isNotNull(), True)
        .otherwise(F.coalesce(F.lower(strip(raw)) == "pass", F.lit(False)))
    )
