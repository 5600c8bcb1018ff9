"""The given tables, and tables that Spark and the SQL twins derive alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

AS_OF_YEAR = 2025

# Tables whose rows take real work each.
_WORDY = {"documents", "pages", "conversations", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in _WORDY else rows


# Company records out of documents: the same text runs in Spark and DuckDB.
# Every document becomes one record of one of two raw catalogues.
COMPANIES = """
SELECT concat('doc_', doc_id) AS startup_id, doc_id AS ordinal,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'Test' ELSE regexp_extract(text, '^[^ ]*', 0) END AS name,
  CASE WHEN doc_id % 23 = 0 THEN '' ELSE text END AS description,
  concat('[''', lang, ''', ''', source, ''']') AS tags, CASE WHEN doc_id % 13 = 0 THEN '' ELSE upper(lang) END AS country, lang,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN '1850' WHEN doc_id % 31 = 0 THEN '2990'
       ELSE CAST(1995 + doc_id % 29 AS VARCHAR(10)) END AS founded_year,
  CASE WHEN doc_id % 4 = 0 THEN 'YC' ELSE 'Crunchbase' END AS source,
  CASE WHEN doc_id % 7 = 0 THEN 'Person' ELSE 'Company' END AS entity_type
FROM documents
"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = COMPANIES.replace("FROM documents", "FROM {documents}")
    return spark.sql(sql, documents=table(spark, sf_dir, "documents"))


def accelerator_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies(spark, sf_dir).filter("source = 'YC'").selectExpr(
        "startup_id AS company_id", "name AS company_name", "lang AS short_description",
        "description AS long_description", "tags", "country", "founded_year AS year_founded", "ordinal",
    )


def registry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies(spark, sf_dir).filter("source = 'Crunchbase'").selectExpr(
        "startup_id AS id", "entity_type", "name", "lang AS category_code",
        "concat(founded_year, '-03-01') AS founded_at", "country AS country_code",
        "'' AS short_description", "description", "lang AS overview", "tags AS tag_list", "ordinal",
    )


# The whitespace class of the cleaning step, in the notation of the SQL twin.
SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def cleaned(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACES}', ' ', 'g'))"


# Cleaned, deduplicated, unified and flagged companies as common table expressions.
CLEAN_CTES = f"""
companies AS ({COMPANIES}),
unioned AS (
  SELECT startup_id, ordinal, {cleaned('name')} AS name,
    {cleaned("CASE WHEN description <> '' THEN description ELSE lang END")} AS description,
    lang AS industry,
    CASE WHEN source = 'YC' THEN array_to_string(regexp_extract_all(tags, '''([^'']*)''', 1), ', ') ELSE tags END AS tags,
    country, CAST(founded_year AS INTEGER) AS founded_year, source
  FROM companies WHERE source = 'YC' OR entity_type = 'Company'
),
unified AS (
  SELECT * FROM unioned WHERE name <> '' AND length(description) > 10
  QUALIFY row_number() OVER (PARTITION BY source, lower(name), founded_year ORDER BY ordinal) = 1
),
flagged AS (
  SELECT *, coalesce(length(name) < 2 OR length(description) < 20
    OR regexp_matches(name, '(?i)^(test|example|demo|sample|company\\d*)$')
    OR founded_year < 1900 OR founded_year > {AS_OF_YEAR} + 1, false) AS is_suspicious
  FROM unified
)
"""

TOKENS = "regexp_extract_all(lower({c}), '[a-z0-9]{{2,}}')"


def tokens_of(c: str) -> str:
    return TOKENS.format(c=c)
