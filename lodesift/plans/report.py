"""Profile and coverage reports of a unified table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import profile
from ..operators.coverage import watch_coverage


def profile_report(df: DataFrame) -> dict[str, DataFrame]:
    """All tables of the profile, by name; each is a small aggregate.

    The text column is read only by the tables that look at its length, so
    store the unified table as Parquet before calling this.
    """
    return {
        "sources": profile.value_counts(df, "source"),
        "top_countries": profile.top_values(df, "country", drop_blank=True),
        "top_industries": profile.top_values(df, "industry", drop_blank=True),
        "founded_per_year": profile.founded_per_year(df),
        "founded_per_year_and_source": profile.founded_per_year(df, by_source=True),
        "quality_share": profile.quality_share(df),
        "quality_by_source": profile.quality_by_source(df),
        "description_lengths": profile.length_histogram(df),
        "median_description": profile.median_length(df),
        "summary": profile.summary_stats(df),
    }


def coverage_report(df: DataFrame, watch: DataFrame, order_by: str = "ordinal") -> dict[str, DataFrame]:
    return {
        "coverage": watch_coverage(df, watch, order_by),
        "suspicious_sample": profile.suspicious_sample(df, order_by),
    }
