"""Profile of a unified, flagged company table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import rounded
from .metrics import share_of_total


def value_counts(df: DataFrame, column: str, *, drop_blank: bool = False) -> DataFrame:
    """Rows per value, nulls left out."""
    kept = df.filter(F.col(column).isNotNull())
    if drop_blank:
        kept = kept.filter(F.col(column) != "")
    return kept.groupBy(column).count()


def top_values(df: DataFrame, column: str, n: int = 15, *, drop_blank: bool = False) -> DataFrame:
    """The most frequent values, ties by value."""
    return value_counts(df, column, drop_blank=drop_blank).orderBy(F.col("count").desc(), column).limit(n)


def founded_per_year(
    df: DataFrame, first: int = 1995, last: int = 2023, by_source: bool = False,
) -> DataFrame:
    keys = ["source", "founded_year"] if by_source else ["founded_year"]
    return df.filter(F.col("founded_year").between(first, last)).groupBy(*keys).count()


def quality_share(df: DataFrame) -> DataFrame:
    """Clean and suspicious rows with their share."""
    return share_of_total(df.groupBy("is_suspicious").count())


def quality_by_source(df: DataFrame) -> DataFrame:
    """Source x quality counts, zero where a combination is missing."""
    return (
        df.groupBy("source").pivot("is_suspicious", [False, True]).count()
        .withColumnsRenamed({"false": "clean", "true": "suspicious"}).na.fill(0, ["clean", "suspicious"])
    )


def length_histogram(df: DataFrame, column: str = "description", clip: int = 2000, bins: int = 60) -> DataFrame:
    """Text lengths clipped at ``clip`` in equal bins between the extremes.

    The upper edge belongs to the last bin.  Lengths are counted per value
    first: every later step works on at most ``clip + 1`` rows.
    """
    lengths = (
        df.select(F.least(F.length(F.coalesce(column, F.lit(""))), F.lit(clip)).alias("len"))
        .groupBy("len").count()
    )
    low, high = lengths.agg(F.min("len")).scalar(), lengths.agg(F.max("len")).scalar()
    width = (high - low) / F.lit(float(bins))
    bin_of = F.when(high == low, 0).otherwise(
        F.least(F.floor((F.col("len") - low) / width), F.lit(bins - 1))
    ).cast("int")
    return (
        lengths.select(bin_of.alias("bin"), (low + bin_of * width).alias("lower"), "count")
        .groupBy("bin").agg(rounded(F.min("lower"), 6).alias("lower_edge"), F.sum("count").alias("count"))
    )


def median_length(df: DataFrame, column: str = "description") -> DataFrame:
    """Exact median text length from counts per length."""
    counts = df.select(F.length(F.coalesce(column, F.lit(""))).alias("len")).groupBy("len").count()
    return counts.agg(F.percentile("len", F.lit(0.5), F.col("count")).alias("median_length"))


def summary_stats(df: DataFrame, sources: dict[str, str] | None = None) -> DataFrame:
    """Totals, distinct values (blank is none), suspicious share and medians in one row.

    ``sources`` maps output column to source name.
    """
    pairs = sources or {"accelerator_rows": "YC", "registry_rows": "Crunchbase"}
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.nullif(F.col("country"), F.lit(""))).alias("countries"),
        F.count_distinct(F.nullif(F.col("industry"), F.lit(""))).alias("industries"),
        *[F.count_if(F.col("source") == name).alias(out) for out, name in pairs.items()],
        F.count_if("is_suspicious").alias("suspicious"),
        rounded(F.avg(F.col("is_suspicious").cast("double")) * 100, 1).alias("suspicious_pct"),
        F.median("founded_year").alias("median_year"),
        F.median(F.length("description")).alias("median_description"),
    )


def profile_state(df: DataFrame, *keys: str) -> DataFrame:
    """A mergeable profile for each combination of ``keys`` (a batch, a source): counts and sketches, no texts.

    Distinct names, countries and industries are HyperLogLog sketches, years and
    description lengths KLL sketches.
    """
    distinct = {c: F.hll_sketch_agg(F.nullif(F.col(c), F.lit(""))).alias(f"{c}_sketch") for c in ("name", "country", "industry")}
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_suspicious").alias("suspicious"), *distinct.values(),
        F.kll_sketch_agg_bigint(F.col("founded_year").cast("long")).alias("year_sketch"),
        F.kll_sketch_agg_bigint(F.length(F.coalesce("description", F.lit(""))).cast("long")).alias("length_sketch"),
    )


def merged_profile(states: DataFrame) -> DataFrame:
    """One row out of any number of states: totals, estimated distinct values and medians."""
    merged = states.agg(
        F.sum("rows").alias("total"), F.sum("suspicious").alias("suspicious"),
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(out) for c, out in (("name", "names"), ("country", "countries"), ("industry", "industries"))],
        F.kll_merge_agg_bigint("year_sketch").alias("years"), F.kll_merge_agg_bigint("length_sketch").alias("lengths"),
    )
    # An empty sketch has no quantile.
    middle = lambda c: F.when(F.kll_sketch_get_n_bigint(c) > 0, F.kll_sketch_get_quantile_bigint(c, F.lit(0.5)))
    return merged.select(
        "total", "suspicious", "names", "countries", "industries", middle("years").alias("median_year"), middle("lengths").alias("median_description"))


def suspicious_sample(df: DataFrame, order_by: str, n: int = 10) -> DataFrame:
    """The first ``n`` suspicious rows, for reading."""
    return df.filter("is_suspicious").orderBy(order_by).limit(n)
