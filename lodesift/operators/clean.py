"""Cleaning, unification, deduplication and quality flags of company records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import (
    ACCELERATOR_RENAMES, ACCELERATOR_SOURCE, REGISTRY_ENTITY_TYPE, REGISTRY_RENAMES,
    REGISTRY_SOURCE, STARTUP_COLUMNS, CleanConfig,
)
from ..functions.numbers import whole_number, year_of
from ..functions.rules import quality_rules
from ..functions.text import blank_to_null, clean_text, first_tag, parse_tags


def long_or_short(long: Column, short: Column) -> Column:
    return F.coalesce(blank_to_null(long), short)


def registry_description(
    description: Column, overview: Column, short: Column, industry: Column, tags: Column, mode: str = "intended",
) -> Column:
    """Description fallback of registry rows; inputs are cleaned text.

    ``intended`` goes on to the short description and a generated sentence;
    ``compat`` stops after the overview, where the original chain ends.
    """
    if mode == "compat":
        return F.coalesce(blank_to_null(description), overview)
    if mode != "intended":
        raise ValueError(f"unknown mode {mode!r}")
    sentence = clean_text(F.concat(F.lit("Startup in "), industry, F.lit(" industry. Tags: "), tags))
    return F.coalesce(blank_to_null(description), blank_to_null(overview), blank_to_null(short), sentence)


def keep_first(df: DataFrame, keys: list[Column], order_by: str = "ordinal") -> DataFrame:
    """One row per key, the first in ``order_by``; null keys equal each other.

    Spark limits every key to one row before the shuffle (``WindowGroupLimit``),
    so a key that holds a large share of the table moves one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(order_by)
    return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are evaluated exactly once per row.

    Filters on them would otherwise be pushed below the projection, and the
    text patterns evaluated again in every filter and every use.  The row goes
    through a one-element array, which no predicate is pushed through.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*kept, F.inline(made))


def finalise(df: DataFrame, source: str, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Shared last steps of both catalogues.

    Expects clean text columns, ``founded_year`` as a number and ``ordinal``.
    """
    kept = df.filter((F.col("name") != "") & (F.length("description") > cfg.min_description))
    kept = kept.withColumn("source", F.lit(source))
    return keep_first(kept, [F.lower("name"), F.col("founded_year")]).select(*STARTUP_COLUMNS, "ordinal")


def clean_accelerator(raw: DataFrame, cfg: CleanConfig = CleanConfig(), source: str = ACCELERATOR_SOURCE) -> DataFrame:
    """Accelerator rows to the unified columns (plus ``ordinal``)."""
    df = computed_once(raw.withColumnsRenamed(ACCELERATOR_RENAMES), {
        "name": clean_text("name"),
        "long_description": clean_text("long_description"),
        "short_description": clean_text("short_description"),
        "tags": clean_text(parse_tags("tags")),
        "country": clean_text("country"),
        "founded_year": whole_number(F.col("founded_year")),
    })
    df = df.withColumns({
        "description": long_or_short(F.col("long_description"), F.col("short_description")),
        "industry": first_tag("tags"),
    })
    return finalise(df, source, cfg)


def clean_registry(
    raw: DataFrame, cfg: CleanConfig = CleanConfig(), source: str = REGISTRY_SOURCE,
    entity_type: str = REGISTRY_ENTITY_TYPE, mode: str = "intended",
) -> DataFrame:
    """Registry rows of one entity type to the unified columns (plus ``ordinal``)."""
    df = raw.filter(F.col("entity_type") == entity_type).withColumnsRenamed(REGISTRY_RENAMES)
    df = computed_once(df, {
        "name": clean_text("name"),
        "short_description": clean_text("short_description"),
        "description": clean_text("description"),
        "overview": clean_text("overview"),
        "industry": clean_text("category_code"),
        "tags": clean_text("tag_list"),
        "country": clean_text("country"),
        "founded_year": year_of(F.col("founded_at"), cfg.date_format),
    })
    return finalise(df.withColumn("description", registry_description(
        F.col("description"), F.col("overview"), F.col("short_description"), F.col("industry"), F.col("tags"), mode,
    )), source, cfg)


def unify(*tables: DataFrame) -> DataFrame:
    """Bag union of cleaned catalogues: duplicates across sources stay."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def flag_suspicious(
    df: DataFrame, as_of_year: int | Column | None = None, cfg: CleanConfig = CleanConfig(), reasons: bool = False,
) -> DataFrame:
    """Add ``is_suspicious`` and, on request, the array of rules that fired."""
    if as_of_year is None:
        as_of_year = F.year(F.current_date())
    elif isinstance(as_of_year, int):
        as_of_year = F.lit(as_of_year)
    rules = {name: F.coalesce(rule, F.lit(False)) for name, rule in quality_rules(as_of_year, cfg).items()}
    any_rule = F.lit(False)
    for rule in rules.values():
        any_rule = any_rule | rule
    df = df.withColumn("is_suspicious", any_rule)
    if reasons:
        fired = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
        df = df.withColumn("reasons", F.array_compact(fired))
    return df


def cleaning_report(raw_counts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Rows in and out, drop share and suspicious rows per source and overall.

    ``raw_counts`` has ``source, raw_rows, entity_rows``: the second count is
    taken after the entity filter, so that the share lost to the filter and the
    share lost to cleaning can be told apart.
    """
    kept = flagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("kept_rows"),
        F.sum(F.col("is_suspicious").cast("long")).alias("suspicious_rows"),
    )
    # A handful of sources on both sides: everything below runs on aggregates.
    joined = raw_counts.join(kept, "source", "left").na.fill(0, ["kept_rows", "suspicious_rows"])
    total = joined.rollup("source").agg(
        *[F.sum(c).alias(c) for c in ("raw_rows", "entity_rows", "kept_rows", "suspicious_rows")]
    )

    def dropped(of: str) -> Column:
        share = (1 - F.col("kept_rows") / F.col(of)) * 100
        return F.when(F.col(of) > 0, F.round(share, 2)).otherwise(F.lit(0.0))

    return total.select(
        F.coalesce("source", F.lit("all")).alias("source"),
        "raw_rows", "entity_rows", "kept_rows",
        dropped("raw_rows").alias("drop_pct"),
        dropped("entity_rows").alias("clean_drop_pct"),
        "suspicious_rows",
    )


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


__all__ = [
    "clean_accelerator", "clean_registry", "cleaning_report", "computed_once", "finalise", "flag_suspicious",
    "keep_first", "long_or_short", "registry_description", "require_columns", "unify",
]
