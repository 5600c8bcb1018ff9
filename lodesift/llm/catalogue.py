"""The numbered operators as queries over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import blockmax, bpe, flat_graph, group_matrix, kneser_ney, language, manifest, mixture, outliers, secrets, toxicity, twins, vafile, windows

VOCABULARY = "byte_bpe_50k.json"
MAX_REPEATS = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_matrix.jaccard_components(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture.mixed(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS)
    return rows.select("doc_id", "source", "epoch", "block", "place", "turn")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.digests(table(spark, sf_dir, "documents"))


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.scores(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.topk(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited(table(spark, sf_dir, "documents"), manifest.tampered())


QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_secrets": op6_secrets,
    "op7_substrings": op7_substrings,
    "op8_perplexity": op8_perplexity,
    "op9_language": op9_language,
    "op10_topk": op10_topk,
    "op11_outliers": op11_outliers,
    "op12_ranked_search": op12_ranked_search,
    "op13_manifest": op13_manifest,
}

# The budgets by bisection, then every document by the running sum of its source's last epoch.
MIXING = f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS key,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n
  FROM documents
), sources AS (
  SELECT key, count(*) AS docs, sum(n) AS tokens, sum(n) / CAST(greatest(sum(sum(n)) OVER (), 1) AS DOUBLE) AS share
  FROM counted GROUP BY key
), facts AS (SELECT max(share) AS most FROM sources WHERE tokens > 0),
bisect(low, high) AS (
  SELECT -1, 16777216
  UNION ALL
  SELECT CASE WHEN holds THEN low ELSE mid END, CASE WHEN holds THEN mid ELSE high END
  FROM (
    SELECT low, high, (low + high) // 2 AS mid,
      (SELECT max(pow(most / share, 1 - ((low + high) // 2) / 16777216.0)) <= {MAX_REPEATS} * (1 + 1e-9) FROM sources, facts WHERE tokens > 0) AS holds
    FROM bisect WHERE high - low > 1
  )
), power AS (SELECT min(high) / 16777216.0 AS exponent FROM bisect),
plan AS (
  SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs,
    budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END * tokens AS rest, (docs + 499) // 500 AS blocks
  FROM (
    SELECT key, docs, CAST(tokens AS BIGINT) AS tokens,
      CAST(floor(tokens * CASE WHEN share > 0 THEN round(pow(most / share, 1 - exponent), 6) ELSE 1.0 END) AS BIGINT) AS budget
    FROM sources, facts, power
  )
), copies AS (
  SELECT doc_id, source, key, n, epochs, blocks, rest, budget, tokens, CAST(unnest(range(0, epochs + 1)) AS INTEGER) AS epoch
  FROM counted JOIN plan USING (key)
), placed AS (
  SELECT *, CAST('0x' || substr(md5('17:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM copies
), summed AS (
  SELECT *, place % blocks AS block, sum(n) OVER (PARTITION BY key, epoch ORDER BY place % blocks, place) AS running FROM placed
), jittered AS (
  SELECT *, CAST('0x' || substr(md5('17:' || key || '/' || epoch || ':' || block), 1, 15) AS BIGINT) / 1152921504606846976.0 AS jitter,
    greatest(budget / CAST(greatest(tokens, 1) AS DOUBLE), 1.0) AS span
  FROM summed WHERE epoch < epochs OR running <= rest AND rest > 0
)
SELECT doc_id, source, epoch, block, place,
  round(least((epoch + (block + jitter) / blocks) / span, 1.0), 6) AS turn
FROM jittered
"""

ORACLES: dict[str, str] = {
    "op4_mixing": MIXING,
    "op1_near_vectors": twins.NEAR_VECTORS,
    "op3_ngram_jaccard": twins.JACCARD,
    "op7_substrings": twins.SUBSTRINGS,
    "op12_ranked_search": twins.RANKED,
    "op13_manifest": twins.MANIFEST,
    "op10_topk": """
WITH numbers AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM numbers q JOIN numbers c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
}
