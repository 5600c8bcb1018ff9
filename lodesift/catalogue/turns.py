"""Conversation history in batch and as streams; index maintenance as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.embed import HashedEncoder
from ..operators.history import record_turns, with_history
from ..session import scratch_path
from ..sources.store import IndexStore
from ..streaming.conversation import append_turns, recent_turns, write_histories, write_recent
from ..streaming.index_updates import maintain_index
from .tables import table, tokens_of


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: a stream takes a single file only by a pattern."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "history")


def history_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every conversation cut into chunks of three turns."""
    return with_history(table(spark, sf_dir, "conversations"), chunk=3).select("conv_id", "turn", "history")


def recorded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user and an assistant row for every document as the answer."""
    answers = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), (F.col("doc_id") * 2).alias("turn"), F.col("source").alias("user_query"),
        F.col("text").alias("answer"),
    )
    return record_turns(answers)


def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "recent")
    write_recent(recent_turns(_stream(spark, sf_dir, "conversations")), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("conv_id", "turn", "history")


def history_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories over micro-batches that cut most conversations: turns arrive in four files, by number."""
    out = scratch_path(spark, "histories")
    given = table(spark, sf_dir, "conversations").withColumn("quarter", F.ntile(4).over(Window.partitionBy("conv_id").orderBy("turn")))
    for n in range(1, 5):
        given.filter(F.col("quarter") == n).drop("quarter").coalesce(1).write.mode("append").parquet(f"{out}/arriving")
    stream = spark.readStream.schema(given.drop("quarter").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/arriving")
    write_histories(stream, f"{out}/told", f"{out}/checkpoint", chunk=3).awaitTermination()
    return spark.read.parquet(f"{out}/told/turns").select("conv_id", "turn", "history")


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "log")
    append_turns(_stream(spark, sf_dir, "conversations"), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("conv_id", "turn", "role", "text")


def index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six micro-batches, in which a fifth of all documents comes twice, with a merge of batches on the way."""
    out = scratch_path(spark, "index-stream")
    given = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("meta_lang"))
    given.union(given.filter("doc_id % 5 = 0")).repartition(6).write.parquet(f"{out}/arriving")
    docs = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/arriving")
    maintain_index(docs, f"{out}/index", f"{out}/checkpoint", "docs", encoder=HashedEncoder(64)).awaitTermination()
    return IndexStore(spark, f"{out}/index").terms().filter("term IS NOT NULL").select("term", "df")


QUERIES = {f.__name__: f for f in (
    history, history_in_chunks, history_by_batches, recorded_turns, history_stream, log_stream, index_stream,
)}

_HISTORY = """
WITH lines AS (SELECT conv_id, turn, '  ' || role || ': ' || CASE WHEN role = 'assistant' AND length(text) > 300
    THEN substring(text, 1, 300) || '…' ELSE text END AS line FROM conversations),
w AS (SELECT conv_id, turn, list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS l
  FROM lines)
SELECT conv_id, turn, CASE WHEN len(l) > 0 THEN 'Recent conversation:' || chr(10) || array_to_string(l, chr(10))
  || chr(10) || chr(10) ELSE '' END AS history FROM w"""

ORACLES = {
    "history": _HISTORY,
    "history_in_chunks": _HISTORY,
    "history_by_batches": _HISTORY,
    "recorded_turns": """
SELECT doc_id AS conv_id, doc_id * 2 AS turn, 'user' AS role, source AS text FROM documents UNION ALL
SELECT doc_id, doc_id * 2 + 1, 'assistant', text FROM documents""",
    "history_stream": _HISTORY,
    "log_stream": "SELECT conv_id, turn, role, text FROM conversations",
    "index_stream": f"""
SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tokens_of('text')}) AS term FROM documents) GROUP BY 1""",
}
