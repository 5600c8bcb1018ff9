"""Conversation log as a stream: append, and the last turns per conversation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import AnswerConfig, SizeLimits
from ..operators.history import FOOTER, HEADER, history_line, with_history
from ..operators.sizing import broadcast_if_small
from ..session import materialise


def append_turns(turns: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append a stream of turns to a log table.

    A micro-batch lands in its own ``batch=<n>`` folder and replaces it when
    Spark repeats the batch, so both rows of an exchange appear together and
    exactly once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def recent_turns(
    turns: DataFrame, window: int = AnswerConfig.memory_window, assistant_chars: int = AnswerConfig.assistant_chars,
    idle_minutes: int | None = None,
) -> DataFrame:
    """``conv_id, turn, role, text, history`` for a stream of turns.

    State per conversation is the last ``window`` rendered lines.  Within a
    micro-batch turns are taken by number; across batches in order of arrival,
    as a log grows.  With ``idle_minutes`` the state of silent conversations is
    dropped.
    """
    prepared = turns.select(
        "conv_id", "turn", "role", "text",
        history_line(F.col("role"), F.col("text"), assistant_chars).alias("line"),
    )

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lines = list(state.get[0]) if state.exists else []
        # One conversation's rows of one micro-batch: bounded by the source's rate limit, without one use write_histories.
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        histories = []
        for line in rows["line"]:
            histories.append(HEADER + "\n".join(lines) + FOOTER if lines else "")
            lines = [*lines, line][-window:]
        state.update((lines,))
        if idle_minutes:
            state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame({
            "conv_id": rows["conv_id"], "turn": rows["turn"], "role": rows["role"], "text": rows["text"],
            "history": histories,
        })

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout
    return prepared.groupBy("conv_id").applyInPandasWithState(
        update, "conv_id bigint, turn bigint, role string, text string, history string",
        "lines array<string>", "append", timeout,
    )


def write_histories(
    turns: DataFrame, path: str, checkpoint: str, window: int = AnswerConfig.memory_window,
    assistant_chars: int = AnswerConfig.assistant_chars, *, once: bool = True, chunk: int = 4096,
) -> StreamingQuery:
    """Histories of a stream of turns, for conversations of any size in a micro-batch.

    Every micro-batch meets the last ``window`` turns of its own conversations
    and is then one batch job, which cuts long conversations into chunks: a
    conversation that holds a third of all rows spreads over tasks.  Below
    ``path`` lie ``turns`` (with ``history``) and ``last`` (the turns that the
    next batches start from), a folder per micro-batch; a repeated micro-batch
    replaces its own.  Turns are taken by number and arrive as a log grows.
    """
    root = path.rstrip("/")

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = materialise(batch.select("conv_id", "turn", "role", "text").withColumn("__old", F.lit(False)), "turns")
        asked = broadcast_if_small(rows.select("conv_id").distinct(), SizeLimits().broadcast_bytes)
        both = rows
        before = [f"{root}/last/batch={n}" for n in _batches(spark, f"{root}/last") if n < number]
        if before:
            known = spark.read.option("basePath", f"{root}/last").parquet(*before).join(asked, "conv_id", "left_semi")
            newest = F.max("batch").over(Window.partitionBy("conv_id"))
            known = known.withColumn("__newest", newest).filter("batch = __newest").select("conv_id", "turn", "role", "text", F.lit(True).alias("__old"))
            both = materialise(rows.unionByName(known), "turns-and-last")
        told = with_history(both, window, assistant_chars, chunk).filter(~F.col("__old")).drop("__old")
        told.write.mode("overwrite").parquet(f"{root}/turns/batch={number}")
        order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
        last = both.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= window).select("conv_id", "turn", "role", "text")
        last.write.mode("overwrite").parquet(f"{root}/last/batch={number}")

    writer = turns.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the ``batch=<n>`` folders that are there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def write_recent(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """File sink for :func:`recent_turns`: exactly once through the sink's own log."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
