"""Cleaning, documents, profile and coverage of company records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import PANDAS_MISSING_TOKENS
from ..operators import profile
from ..operators.clean import clean_accelerator, clean_registry, cleaning_report, flag_suspicious, unify
from ..operators.automaton import mentions
from ..operators.coverage import watch_coverage
from ..operators.documents import build_documents, dense_ids, where
from ..operators.metrics import share_of_total
from ..functions.text import first_tag, parse_tags
from ..plans.incremental import IncrementalCatalogue
from ..plans.preprocess import preprocess, raw_counts
from ..schemas import ACCELERATOR_RAW
from ..session import materialise, scratch_path
from ..sources.catalog import first_rows, normalise_missing, read_csv, sanitise_for_export, write_table
from .tables import AS_OF_YEAR, CLEAN_CTES, accelerator_raw, cleaned, companies, registry_raw, table

_COLUMNS = [
    "startup_id", "name", "description", "industry", "tags", "country", "founded_year", "source", "is_suspicious",
]


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    unified = unify(clean_accelerator(accelerator_raw(spark, sf_dir)), clean_registry(registry_raw(spark, sf_dir)))
    return flag_suspicious(unified, AS_OF_YEAR)


def clean_unify_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select(*_COLUMNS)


def preprocess_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through CSV files: written once, then read like raw catalogues."""
    root = scratch_path(spark, "raw")
    write_table(accelerator_raw(spark, sf_dir).sort("ordinal").drop("ordinal"), f"{root}/accelerator", "csv")
    write_table(registry_raw(spark, sf_dir).sort("ordinal").drop("ordinal"), f"{root}/registry", "csv")
    done = preprocess(spark, [f"{root}/accelerator"], f"{root}/registry", as_of_year=AS_OF_YEAR)
    return done.unified.select(*_COLUMNS)


# Three snapshots of the accelerator with many keys in common: snapshot, and which rows it has.
_SNAPSHOTS = {1: "ordinal % 3 <> 0", 0: "ordinal % 5 = 0", 2: "ordinal % 2 = 0"}
_SNAPSHOT_ROWS = """
SELECT startup_id AS company_id, CASE WHEN ordinal % 41 = 0 THEN 'None' ELSE name END AS company_name, lang AS short_description,
  concat('snapshot {n}: ', description) AS long_description, tags, CASE WHEN ordinal % 37 = 0 THEN 'NA' ELSE country END AS country,
  founded_year AS year_founded, ordinal FROM companies WHERE source = 'YC' AND {chosen}
"""


def snapshots_one_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV snapshots with the wide set of missing tokens, added one at a time, the earliest second."""
    store = IncrementalCatalogue(spark, scratch_path(spark, "catalogue"))
    for n, chosen in _SNAPSHOTS.items():
        sql = _SNAPSHOT_ROWS.format(n=n, chosen=chosen).replace("FROM companies", "FROM {companies}")
        path = scratch_path(spark, "snapshot")
        write_table(spark.sql(sql, companies=companies(spark, sf_dir)).sort("ordinal").drop("ordinal"), path, "csv")
        raw = normalise_missing(read_csv(spark, path, ACCELERATOR_RAW), PANDAS_MISSING_TOKENS)
        raw = raw.withColumn("ordinal", F.struct(F.lit(n).alias("snapshot"), F.col("ordinal.file"), F.col("ordinal.position")))
        store.add(clean_accelerator(raw), f"snapshot{n}")
    return store.current().select(*_COLUMNS[:-1])


def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred cleaned records in file order."""
    return first_rows(flagged(spark, sf_dir), "ordinal", 100).select(*_COLUMNS)


def suspicious_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    unified = unify(clean_accelerator(accelerator_raw(spark, sf_dir)), clean_registry(registry_raw(spark, sf_dir)))
    flagged_rows = flag_suspicious(unified, AS_OF_YEAR, reasons=True)
    return flagged_rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("records")
    )


def cleaning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = raw_counts(accelerator_raw(spark, sf_dir), "YC").unionByName(
        raw_counts(registry_raw(spark, sf_dir), "Crunchbase", "Company")
    )
    return cleaning_report(counts, flagged(spark, sf_dir))


def tags_and_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies(spark, sf_dir).select("startup_id", parse_tags("tags").alias("tags")).withColumn(
        "industry", first_tag("tags")
    )


def company_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = build_documents(flagged(spark, sf_dir))
    keys = ["startup_id", "source", "is_suspicious", "country", "founded_year"]
    return docs.select("doc_id", "text", *[F.col("metadata")[k].alias(k) for k in keys])


def document_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_ids(flagged(spark, sf_dir), "ordinal").select(
        "startup_id", F.concat(F.lit("doc_"), F.col("position").cast("string")).alias("doc_id")
    )


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = build_documents(flagged(spark, sf_dir))
    return where(docs, {"source": "YC", "is_suspicious": "False"}).select("doc_id", "text")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(flagged(spark, sf_dir), "source")


def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(flagged(spark, sf_dir), "country", drop_blank=True)


def top_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(flagged(spark, sf_dir), "industry", drop_blank=True)


def founded_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.founded_per_year(flagged(spark, sf_dir))


def founded_per_year_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.founded_per_year(flagged(spark, sf_dir), by_source=True)


def quality_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quality_share(flagged(spark, sf_dir))


def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quality_by_source(flagged(spark, sf_dir))


def description_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_histogram(flagged(spark, sf_dir))


def median_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.median_length(flagged(spark, sf_dir))


def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary_stats(flagged(spark, sf_dir))


def suspicious_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.suspicious_sample(flagged(spark, sf_dir), "ordinal").select("startup_id", "name", "source")


def sketched_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sketches of each source and year, merged: exact values, and whether the estimates are within 3 % of them."""
    rows = materialise(flagged(spark, sf_dir), "flagged")
    states = materialise(profile.profile_state(rows, "source", "founded_year"), "states")
    told = profile.merged_profile(states).select(
        F.col("names").alias("names_told"), F.col("industries").alias("industries_told"), F.col("median_description").alias("length_told"))
    lengths = rows.groupBy(F.length("description").alias("len")).count().crossJoin(F.broadcast(told.select("length_told")))
    share = lambda test: F.sum(F.when(test, F.col("count")).otherwise(0)) / F.sum("count")
    within = lengths.agg(((share(F.col("len") < F.col("length_told")) <= 0.53) & (share(F.col("len") <= F.col("length_told")) >= 0.47)).alias("median_within"))
    exact = rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("name").alias("names"), F.count_distinct("industry").alias("industries"))
    close = lambda told, exact: F.abs(F.col(told) - F.col(exact)) <= F.greatest(F.lit(1), 0.03 * F.col(exact))
    return exact.join(told).join(within).select(
        "total", "names", close("names_told", "names").alias("names_within"), "industries", close("industries_told", "industries").alias("industries_within"), "median_within")


def watch_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all benchmark texts, eight characters or longer, wherever they occur inside whole documents."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter(F.length("word") >= 8)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return mentions(docs, "text", words).select("doc_id", "word", "times")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of every benchmark text as the watch list."""
    watch = table(spark, sf_dir, "benchmark").selectExpr("regexp_extract(text, '^[^ ]*', 0) AS name")
    return watch_coverage(flagged(spark, sf_dir), watch)


def sanitised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit("\x01\x0b"), "html", F.lit("\x1f\t")))
    return sanitise_for_export(pages).select("page_id", "url", "html")


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records written and read back."""
    path = scratch_path(spark, "export")
    rows = clean_unify_flag(spark, sf_dir)
    write_table(rows, path, "json")
    return spark.read.schema(rows.schema).json(path).select("startup_id", "name", "founded_year", "is_suspicious")


def event_type_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_of_total(table(spark, sf_dir, "events").groupBy("event_type").count())


def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(table(spark, sf_dir, "lineitem"), "l_partkey")


QUERIES = {f.__name__: f for f in (
    clean_unify_flag, preprocess_csv, snapshots_one_by_one, first_records, suspicious_reasons, cleaning_counts, tags_and_industry, company_documents,
    document_positions, metadata_filter, source_counts, top_countries, top_industries, founded_per_year,
    founded_per_year_and_source, quality_share, quality_by_source, description_lengths, median_description,
    summary_stats, sketched_stats, suspicious_sample, coverage, watch_mentions, sanitised_pages, json_export, event_type_share, top_parts,
)}


def _clean(sql: str) -> str:
    return f"WITH {CLEAN_CTES} {sql}"


_DOCUMENT_SQL = """
SELECT startup_id AS doc_id,
  concat_ws(chr(10), 'Name: ' || name, CASE WHEN industry <> '' THEN 'Industry: ' || industry END,
    CASE WHEN tags <> '' THEN 'Tags: ' || tags END, CASE WHEN country <> '' THEN 'Country: ' || country END,
    'Founded: ' || founded_year::VARCHAR, CASE WHEN description <> '' THEN 'Description: ' || description END) AS text,
  startup_id, source, CASE WHEN is_suspicious THEN 'True' ELSE 'False' END AS is_suspicious, country,
  coalesce(founded_year::VARCHAR, '') AS founded_year
FROM flagged
"""

_MISSING = ", ".join("'" + t + "'" for t in PANDAS_MISSING_TOKENS)
_SNAPSHOT_TWIN = " UNION ALL ".join(f"SELECT {n} AS snapshot, * FROM ({_SNAPSHOT_ROWS.format(n=n, chosen=chosen)})" for n, chosen in _SNAPSHOTS.items())


def _present(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({_MISSING}) THEN {c} ELSE '' END"


ORACLES = {
    "snapshots_one_by_one": _clean(f"""
, arrived AS ({_SNAPSHOT_TWIN}),
tidied AS (SELECT company_id AS startup_id, snapshot, ordinal, {cleaned(_present('company_name'))} AS name, {cleaned('long_description')} AS description,
    short_description AS industry, array_to_string(regexp_extract_all(tags, '\'\'([^\'\']*)\'\'', 1), ', ') AS tags, {_present('country')} AS country,
    CAST(year_founded AS INTEGER) AS founded_year, 'YC' AS source FROM arrived)
SELECT startup_id, name, description, industry, tags, country, founded_year, source FROM tidied WHERE name <> '' AND length(description) > 10
QUALIFY row_number() OVER (PARTITION BY lower(name), founded_year ORDER BY snapshot, ordinal) = 1"""),
    "first_records": _clean(f"SELECT {', '.join(_COLUMNS)} FROM flagged ORDER BY ordinal LIMIT 100"),
    "clean_unify_flag": _clean(f"SELECT {', '.join(_COLUMNS)} FROM flagged"),
    "preprocess_csv": _clean(f"SELECT {', '.join(_COLUMNS)} FROM flagged"),
    "suspicious_reasons": _clean(f"""
SELECT reason, count(*) AS records FROM (
  SELECT unnest([CASE WHEN length(name) < 2 THEN 'short_name' END,
    CASE WHEN length(description) < 20 THEN 'short_description' END,
    CASE WHEN regexp_matches(name, '(?i)^(test|example|demo|sample|company\\d*)$') THEN 'placeholder_name' END,
    CASE WHEN founded_year < 1900 THEN 'year_too_old' END,
    CASE WHEN founded_year > {AS_OF_YEAR} + 1 THEN 'year_in_future' END]) AS reason FROM flagged
) WHERE reason IS NOT NULL GROUP BY reason"""),
    "cleaning_counts": _clean("""
, raw AS (SELECT source, count(*) AS raw_rows,
    count(*) FILTER (source = 'YC' OR entity_type = 'Company') AS entity_rows FROM companies GROUP BY source),
kept AS (SELECT source, count(*) AS kept_rows, count(*) FILTER (is_suspicious) AS suspicious_rows
    FROM flagged GROUP BY source),
both_ AS (SELECT raw.source, raw_rows, entity_rows, coalesce(kept_rows, 0) AS kept_rows,
    coalesce(suspicious_rows, 0) AS suspicious_rows FROM raw LEFT JOIN kept USING (source)),
total AS (SELECT coalesce(source, 'all') AS source, sum(raw_rows)::BIGINT AS raw_rows, sum(entity_rows)::BIGINT AS entity_rows,
    sum(kept_rows)::BIGINT AS kept_rows, sum(suspicious_rows)::BIGINT AS suspicious_rows FROM both_ GROUP BY ROLLUP (source))
SELECT source, raw_rows, entity_rows, kept_rows, round((1 - kept_rows / raw_rows) * 100, 2) AS drop_pct,
  round((1 - kept_rows / entity_rows) * 100, 2) AS clean_drop_pct, suspicious_rows FROM total"""),
    "tags_and_industry": _clean("""
SELECT startup_id, array_to_string(regexp_extract_all(tags, '''([^'']*)''', 1), ', ') AS tags, lang AS industry
FROM companies"""),
    "company_documents": _clean(_DOCUMENT_SQL),
    "document_positions": _clean("""
SELECT startup_id, 'doc_' || (row_number() OVER (ORDER BY ordinal) - 1)::VARCHAR AS doc_id FROM flagged"""),
    "metadata_filter": _clean(f"""
SELECT doc_id, text FROM ({_DOCUMENT_SQL}) WHERE source = 'YC' AND is_suspicious = 'False'"""),
    "source_counts": _clean("SELECT source, count(*) AS count FROM flagged GROUP BY source"),
    "top_countries": _clean(
        "SELECT country, count(*) AS count FROM flagged WHERE country <> '' GROUP BY country ORDER BY count DESC, country LIMIT 15"),
    "top_industries": _clean(
        "SELECT industry, count(*) AS count FROM flagged WHERE industry <> '' GROUP BY industry "
        "ORDER BY count DESC, industry LIMIT 15"),
    "founded_per_year": _clean(
        "SELECT founded_year, count(*) AS count FROM flagged WHERE founded_year BETWEEN 1995 AND 2023 GROUP BY 1"),
    "founded_per_year_and_source": _clean(
        "SELECT source, founded_year, count(*) AS count FROM flagged WHERE founded_year BETWEEN 1995 AND 2023 "
        "GROUP BY 1, 2"),
    "quality_share": _clean(
        "SELECT is_suspicious, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share "
        "FROM flagged GROUP BY 1"),
    "quality_by_source": _clean(
        "SELECT source, count(*) FILTER (NOT is_suspicious) AS clean, count(*) FILTER (is_suspicious) AS suspicious "
        "FROM flagged GROUP BY 1"),
    "description_lengths": _clean("""
, lens AS (SELECT least(length(description), 2000) AS len FROM flagged),
edges AS (SELECT min(len) AS lo, max(len) AS hi FROM lens)
SELECT least(floor((len - lo) / ((hi - lo) / 60.0::DOUBLE)), 59)::INTEGER AS bin,
  round(any_value(lo + least(floor((len - lo) / ((hi - lo) / 60.0::DOUBLE)), 59) * ((hi - lo) / 60.0::DOUBLE)), 6) AS lower_edge,
  count(*) AS count
FROM lens, edges GROUP BY 1"""),
    "median_description": _clean("SELECT median(length(description)) AS median_length FROM flagged"),
    "summary_stats": _clean("""
SELECT count(*) AS total, count(DISTINCT nullif(country, '')) AS countries, count(DISTINCT nullif(industry, '')) AS industries,
  count(*) FILTER (source = 'YC') AS accelerator_rows, count(*) FILTER (source = 'Crunchbase') AS registry_rows,
  count(*) FILTER (is_suspicious) AS suspicious, round(avg(is_suspicious::INTEGER) * 100, 1) AS suspicious_pct,
  median(founded_year) AS median_year, median(length(description)) AS median_description FROM flagged"""),
    "suspicious_sample": _clean(
        "SELECT startup_id, name, source FROM flagged WHERE is_suspicious ORDER BY ordinal LIMIT 10"),
    "sketched_stats": _clean("SELECT count(*) AS total, count(DISTINCT name) AS names, true AS names_within, count(DISTINCT industry) AS industries, true AS industries_within, true AS median_within FROM flagged"),
    "watch_mentions": """
WITH words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) >= 8)
SELECT * FROM (SELECT doc_id, word, ((length(t) - length(replace(t, word, ''))) // length(word))::BIGINT AS times
  FROM (SELECT doc_id, lower(text) AS t FROM documents) JOIN words ON contains(t, word))""",
    "coverage": _clean("""
, watch AS (SELECT DISTINCT regexp_extract(text, '^[^ ]*', 0) AS watch_name FROM benchmark WHERE regexp_extract(text, '^[^ ]*', 0) <> ''),
hit AS (SELECT watch_name, name, source,
    CASE WHEN lower(name) = lower(watch_name) THEN 0 ELSE 1 END AS kind, ordinal
  FROM watch JOIN flagged ON contains(lower(name), lower(watch_name))
  QUALIFY row_number() OVER (PARTITION BY watch_name ORDER BY kind, ordinal) = 1)
SELECT watch_name, CASE WHEN kind IS NULL THEN 'missing' WHEN kind = 0 THEN 'exact' ELSE 'partial' END AS status,
  name AS matched_name, source FROM watch LEFT JOIN hit USING (watch_name)"""),
    "sanitised_pages": """
SELECT page_id, regexp_replace(url, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS url,
  regexp_replace(html || chr(9), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS html FROM pages""",
    "json_export": _clean("SELECT startup_id, name, founded_year, is_suspicious FROM flagged"),
    "event_type_share": """
SELECT event_type, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1""",
    "top_parts": """
SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, l_partkey LIMIT 15""",
}

