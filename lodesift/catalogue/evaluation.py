"""Metrics, summaries and saved results.

``RESULTS`` turns every document into an evaluation row of the run named by
its source, so all roll-ups work on data that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import judge_score, rounded
from ..functions.text import preview, token_estimate, tokens
from ..operators import metrics
from ..operators.lexical import bm25_search
from ..session import scratch_path
from ..sources.runs import newest, read_results_csv, read_saved, save_run, write_results
from .retrieval import _bm25, corpus, questions
from .tables import SPACES, table, tokens_of

RESULTS = """
SELECT concat('q', doc_id) AS id, text AS query, source AS run, lang AS description, substring(text, 1, 40) AS answer_preview,
  CASE doc_id % 6 WHEN 0 THEN 'similar' WHEN 1 THEN 'swot' WHEN 2 THEN 'competitor' WHEN 3 THEN 'comparison'
    WHEN 4 THEN 'ecosystem' ELSE 'auto' END AS analysis_type,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(n_chars % 21 AS DOUBLE) / 20 END AS context_relevancy,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(doc_id % 11 AS DOUBLE) / 10 END AS groundedness,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(n_chars % 6 AS DOUBLE) / 5 END AS answer_relevancy,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(n_chars % 5 AS DOUBLE) / 5 END AS precision_at_k,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(n_chars % 4 AS DOUBLE) / 4 END AS structure_score,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(n_chars % 2 AS DOUBLE) END AS bad_result_check,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(n_chars % 997 AS DOUBLE) / 64 END AS latency_seconds,
  CASE WHEN doc_id % 13 = 0 THEN 'rate limited' END AS error
FROM documents
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESULTS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_summary(results(spark, sf_dir))


def summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary_by_type(results(spark, sf_dir))


def summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary_rollup(results(spark, sf_dir))


def latency_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_summary(results(spark, sf_dir), ["analysis_type"])


def pass_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pass_table(results(spark, sf_dir))


def pass_rate_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pass_rate(results(spark, sf_dir), ["run"])


def metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_matrix(results(spark, sf_dir))


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compare_runs(results(spark, sf_dir))


def saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows through a CSV with quotes and line breaks inside cells."""
    path = scratch_path(spark, "results")
    write_results(results(spark, sf_dir), path)
    written = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    assert set(written.columns) <= {f.name for f in read_results_csv(spark, path).schema}
    return written.select(
        "id", "query", "analysis_type", F.col("context_relevancy").cast("double").alias("context_relevancy")
    )


_RUNS = {"eval_2": "doc_id % 2 = 0", "eval_10": "doc_id % 3 = 0", "eval_30": "doc_id % 5 <> 0"}


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three runs written and read; a fourth died before its summary."""
    path = scratch_path(spark, "runs")
    rows = results(spark, sf_dir).withColumn("doc_id", F.substring("id", 2, 20).cast("long"))
    for run, part in _RUNS.items():
        save_run(rows.filter(part), path, run, model_name=run, provider="rules")
    rows.select("id", "query").write.json(f"{path}/results/run=eval_9")
    return read_saved(spark, path)


def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and averages of every run, out of its summary and again from its rows."""
    summaries, rows = _saved(spark, sf_dir)
    told = summaries.select("run", F.col("summary.model_name").alias("model_name"), F.col("summary.total_queries").cast("long").alias("total_queries"), F.col("summary.successful").cast("long").alias("successful"),
                            F.col("summary.avg_groundedness").alias("avg_groundedness"))
    counted = rows.groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.when(F.col("error").isNull(), F.col("groundedness"))), 3).alias("from_rows"))
    return told.join(counted, "run")


def newest_saved_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the newest run."""
    summaries, rows = _saved(spark, sf_dir)
    return newest(rows, summaries).select("run", "id", "query", "analysis_type", "context_relevancy", "error")


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", preview("text", 200).alias("preview"), token_estimate("text").alias("total_tokens")
    )


_REPLY = """CASE doc_id % 8 WHEN 0 THEN '0.8' WHEN 1 THEN '.5' WHEN 2 THEN '-0.3' WHEN 3 THEN '8/10'
  WHEN 4 THEN 'n/a' WHEN 5 THEN NULL WHEN 6 THEN concat('Score: 0.', n_chars, '.') ELSE text END"""


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", rounded(judge_score(F.expr(_REPLY)), 6).alias("score"))


def bm25_hit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, structure and bad-result check of the BM25 hits of each query.

    Expected keywords, unwanted phrases and headings are words of the query.
    """
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    hits = bm25_search(docs, asked, 5).join(docs.select("doc_id", "text"), "doc_id")
    texts = hits.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]).alias("texts")
    )
    words = tokens("text")
    return asked.join(texts, "query_id", "left").select(
        "query_id",
        rounded(metrics.precision_at_k(F.coalesce("texts", F.array().cast("array<string>")), F.slice(words, 1, 2)), 6)
        .alias("precision_at_k"),
        rounded(metrics.structure_score(F.array_join("texts", "\n"), F.slice(words, 3, 5)), 6).alias("structure_score"),
        metrics.bad_result_check(F.col("texts"), F.slice(words, -2, 2)).alias("bad_result_check"),
    )


def joined_hit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    hits = bm25_search(docs, questions(spark, sf_dir), 5).join(docs.select("doc_id", "text"), "doc_id")
    return metrics.joined_texts(hits, first=5)


QUERIES = {f.__name__: f for f in (
    run_summary, summary_by_type, summary_rollup, latency_by_type, pass_table, pass_rate_by_run, metric_matrix,
    compare_runs, saved_results, saved_runs, newest_saved_run, previews, judge_replies, bm25_hit_metrics, joined_hit_texts,
)}


def _averages(names=metrics.METRICS) -> str:
    return ", ".join(f"round(avg({m}), 3) AS avg_{m}" for m in names)


_SUMMARY = f"""count(*) AS total_queries, count(*) FILTER (error IS NULL) AS successful,
  count(*) FILTER (error IS NOT NULL) AS failed, round(sum(latency_seconds), 1) AS total_time_seconds,
  round(avg(latency_seconds), 2) AS avg_latency_seconds, {_averages()}"""
_WITH = f"WITH results AS ({RESULTS})"
_PASSED = "context_relevancy >= 0.7::DOUBLE AND groundedness >= 0.7::DOUBLE AND answer_relevancy >= 0.7::DOUBLE"
_CORE = "(context_relevancy + groundedness + answer_relevancy) / 3"
_HITS = f"""WITH {_bm25(k=5)}, texts AS (
  SELECT query_id, list(text ORDER BY rank) AS texts FROM bm JOIN documents USING (doc_id) GROUP BY 1),
words AS (SELECT item_id AS query_id, {tokens_of('text')} AS w FROM benchmark)"""

_RUN_ROWS = " UNION ALL ".join(f"SELECT '{run}' AS saved, * FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS doc_id FROM results) WHERE {part}" for run, part in _RUNS.items())

ORACLES = {
    "saved_runs": f"""{_WITH}, r AS ({_RUN_ROWS}) SELECT saved AS run, saved AS model_name, count(*) AS total_queries, count(*) FILTER (error IS NULL) AS successful,
  round(avg(groundedness), 3) AS avg_groundedness, count(*) AS rows, round(avg(groundedness), 3) AS from_rows FROM r GROUP BY saved""",
    "newest_saved_run": f"""{_WITH}, r AS ({_RUN_ROWS}) SELECT saved AS run, id, query, analysis_type, context_relevancy, error FROM r
  WHERE saved = (SELECT max(saved) FROM r)""",
    "run_summary": f"{_WITH} SELECT {_SUMMARY}, CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN 'All queries failed' END AS error FROM results",
    "summary_by_type": f"""{_WITH} SELECT analysis_type, count(*) AS count,
  {_averages([*metrics.CORE, 'precision_at_k'])} FROM results WHERE error IS NULL GROUP BY 1""",
    "summary_rollup": f"{_WITH} SELECT coalesce(analysis_type, 'all') AS analysis_type, {_SUMMARY} FROM results GROUP BY ROLLUP (analysis_type)",
    "latency_by_type": f"""{_WITH} SELECT analysis_type, round(avg(latency_seconds), 3) AS avg_latency,
  min(latency_seconds) AS min_latency, max(latency_seconds) AS max_latency FROM results GROUP BY 1""",
    "pass_table": f"""{_WITH} SELECT id, analysis_type, {', '.join(metrics.METRICS)}, round({_CORE}, 2) AS avg_core,
  {_PASSED} AS passed FROM results WHERE error IS NULL""",
    "pass_rate_by_run": f"""{_WITH} SELECT run, count(*) AS scored, count(*) FILTER ({_PASSED}) AS passed,
  round(avg(CASE WHEN {_PASSED} THEN 1.0::DOUBLE ELSE 0 END), 4) AS pass_rate, round(avg({_CORE}), 4) AS avg_core
  FROM results WHERE error IS NULL GROUP BY 1""",
    "metric_matrix": f"{_WITH} " + " UNION ALL ".join(
        f"SELECT id, '{m}' AS metric, {m} AS score FROM results WHERE error IS NULL" for m in metrics.METRICS),
    "compare_runs": f"{_WITH} SELECT run, {_SUMMARY} FROM results GROUP BY 1",
    "saved_results": f"{_WITH} SELECT id, query, analysis_type, context_relevancy FROM results WHERE error IS NULL",
    "previews": f"""
SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS preview,
  2 * len(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> ''))::INTEGER AS total_tokens FROM documents""",
    "judge_replies": f"""
SELECT doc_id, round(coalesce(least(greatest(try_cast(regexp_extract(raw, '(\\d+\\.?\\d*)', 1) AS DOUBLE), 0), 1), 0), 6) AS score
FROM (SELECT doc_id, {_REPLY} AS raw FROM documents)""",
    "bm25_hit_metrics": f"""{_HITS}
SELECT query_id,
  round(len(list_filter(texts, lambda t: len(list_filter(w[1:2], lambda k: contains(lower(t), k))) > 0)) / len(texts)::DOUBLE, 6)
    AS precision_at_k,
  CASE WHEN len(w) < 3 THEN 1.0::DOUBLE ELSE round(len(list_filter(w[3:7],
    lambda k: contains(lower(array_to_string(texts, chr(10))), k))) / len(w[3:7])::DOUBLE, 6) END AS structure_score,
  CASE WHEN len(list_filter(w[-2:], lambda k: contains(lower(array_to_string(texts, ' ')), k))) > 0 THEN 0.0::DOUBLE
    ELSE 1.0 END AS bad_result_check
FROM words JOIN texts USING (query_id)""",
    "joined_hit_texts": f"""{_HITS} SELECT query_id, array_to_string(texts[1:5], chr(10) || chr(10) || '---' || chr(10) || chr(10))
  AS documents FROM texts""",
}
