"""Saved evaluation runs: JSON with summary and results, CSV of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.metrics import METRICS, run_summary, summary_by_type
from ..schemas import EVAL_RESULT, EVAL_RUN

_BY_TYPE = ["count", "avg_context_relevancy", "avg_groundedness", "avg_answer_relevancy", "avg_precision_at_k"]
_CSV = [
    "id", "query", "analysis_type", "model_name", "description", "answer_preview", "num_sources",
    *METRICS, "latency_seconds", "total_tokens",
]


def run_document(results: DataFrame, model_name: str | None = None, provider: str | None = None) -> DataFrame:
    """One row ``summary, results`` in the layout of a saved run.

    The results array is one file's worth of evaluation items; keep large
    result sets as tables and save them with :func:`save_run` instead.
    """
    by_type = summary_by_type(results).agg(
        F.map_from_entries(F.collect_list(F.struct("analysis_type", F.struct(*_BY_TYPE)))).alias("by_analysis_type")
    )
    rows = [F.col(f.name) if f.name in results.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in EVAL_RESULT.fields]
    listed = results.select(*rows).agg(F.sort_array(F.collect_list(F.struct(*EVAL_RESULT.fieldNames()))).alias("results"))
    summary = run_summary(results)
    fields = [
        F.current_timestamp().cast("string").alias("run_date"),
        F.lit(model_name).cast("string").alias("model_name"), F.lit(provider).cast("string").alias("llm_provider"),
        *[F.col(c) for c in summary.columns if c != "error"],
        by_type.scalar().alias("by_analysis_type"), F.col("error"),
    ]
    return summary.select(F.struct(*fields).alias("summary"), listed.scalar().alias("results"))


def write_run(results: DataFrame, json_path: str, csv_path: str | None = None, **labels: str | None) -> None:
    """Save a run as JSON, and its scored rows as CSV."""
    run_document(results, **labels).write.mode("overwrite").json(json_path)
    if csv_path:
        write_results(results, csv_path)


def write_results(results: DataFrame, path: str) -> None:
    scored = results.filter(F.col("error").isNull())
    scored.select(*[c for c in _CSV if c in results.columns]).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', quoteAll=True
    )


def save_run(results: DataFrame, path: str, run: str, model_name: str | None = None, provider: str | None = None) -> None:
    """Save a run of any size below ``path``: results as JSON lines and as CSV, and then the summary, which makes it visible.

    The results stay a table (a line per item, any number of files); a run that
    is saved again replaces itself.
    """
    root = path.rstrip("/")
    rows = results.select(*[F.col(f.name) if f.name in results.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVAL_RESULT.fields])
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{root}/results/run={run}")
    write_results(results, f"{root}/csv/run={run}")
    summary = run_summary(results)
    by_type = summary_by_type(results).agg(
        F.map_from_entries(F.collect_list(F.struct("analysis_type", F.struct(*_BY_TYPE)))).alias("by_analysis_type"))
    told = {
        "run_date": F.current_timestamp().cast("string"), "model_name": F.lit(model_name).cast("string"),
        "llm_provider": F.lit(provider).cast("string"), "by_analysis_type": by_type.scalar(), **{c: F.col(c) for c in summary.columns},
    }
    row = F.struct(*[told[c].alias(c) for c in EVAL_RUN["summary"].dataType.fieldNames()])
    summary.select(row.alias("summary")).coalesce(1).write.mode("overwrite").json(f"{root}/summaries/run={run}")


def read_saved(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``run, summary``) and (``run``, one row per item) of all complete runs that :func:`save_run` has left."""
    root = path.rstrip("/")
    summary = EVAL_RUN["summary"]
    summaries = spark.read.schema(type(EVAL_RUN)([summary])).json(f"{root}/summaries").select("run", "summary")
    results = spark.read.schema(EVAL_RESULT).json(f"{root}/results")
    # A handful of runs: their names decide which folders are read.
    names = [r["run"] for r in summaries.select("run").collect()]
    return summaries, results.filter(F.col("run").isin(names)).select("run", *EVAL_RESULT.fieldNames())


def newest(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Rows of the run with the greatest name; the folders of others are not read."""
    return rows.filter(F.col("run") == summaries.agg(F.max("run")).first()[0])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All saved runs below ``path``: ``run`` (file name), ``summary``, ``results``."""
    return (
        spark.read.schema(EVAL_RUN).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path)
        .select(F.col("_metadata.file_name").alias("run"), "summary", "results")
    )


def run_results(runs: DataFrame) -> DataFrame:
    """One row per run and query."""
    return runs.select("run", F.inline("results"))


def newest_run(runs: DataFrame) -> DataFrame:
    """The run with the greatest file name."""
    return runs.filter(F.col("run") == runs.agg(F.max("run")).scalar())


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scored rows of a saved CSV; cells may hold quotes and line breaks."""
    fields = [f for f in EVAL_RESULT.fields if f.name in _CSV]
    schema = type(EVAL_RESULT)(sorted(fields, key=lambda f: _CSV.index(f.name)))
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


__all__ = ["newest", "newest_run", "read_saved", "save_run", "read_results_csv", "read_runs", "run_document", "run_results",
           "write_results", "write_run"]
