"""Conversation history: the last turns before each turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import AnswerConfig
from ..functions.text import preview

# The layout of a rendered history.
HEADER = "Recent conversation:\n"
FOOTER = "\n\n"


def history_line(role: Column, text: Column, assistant_chars: int = AnswerConfig.assistant_chars) -> Column:
    text = F.coalesce(text, F.lit(""))
    body = F.when(role == "assistant", preview(text, assistant_chars)).otherwise(text)
    return F.concat(F.lit("  "), F.coalesce(role, F.lit("?")), F.lit(": "), body)


def render_history(lines: Column) -> Column:
    """Rendered history of an array of lines, empty when there is none."""
    return F.when(
        F.size(lines) > 0, F.concat(F.lit(HEADER), F.array_join(lines, "\n"), F.lit(FOOTER))
    ).otherwise(F.lit(""))


def _last(array: Column, n: int) -> Column:
    size = F.size(array)
    return F.when(size > n, F.slice(array, size - n + 1, F.lit(n))).otherwise(array)


def with_history(
    turns: DataFrame, window: int = AnswerConfig.memory_window, assistant_chars: int = AnswerConfig.assistant_chars,
    chunk: int = 4096,
) -> DataFrame:
    """Add ``history``: the up to ``window`` turns before each turn, oldest first.

    A conversation is cut into chunks of ``chunk`` turn numbers and each chunk
    starts with the last turns of the chunks before it, so that even one very
    long conversation spreads over many tasks.
    """
    lines = turns.select(
        *turns.columns, history_line(F.col("role"), F.col("text"), assistant_chars).alias("line"),
        F.floor(F.col("turn") / chunk).alias("chunk"),
    )
    newest = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").desc())
    ends = (
        lines.select("conv_id", "chunk", "turn", "line")
        .withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= window)
        .groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("end"))
    )
    # Every chunk holds at least one turn, so ``window`` earlier chunks always suffice.
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(-window, -1)
    carried = (
        ends.withColumn("carried", _last(F.flatten(F.collect_list("end").over(before)), window))
        .select("conv_id", "chunk", F.explode("carried").alias("c"))
        .select("conv_id", "chunk", "c.turn", "c.line", F.lit(True).alias("__carried"))
    )
    both = lines.withColumn("__carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    previous = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(-window, -1)
    return (
        both.withColumn("lines", F.collect_list("line").over(previous))
        .filter(~F.col("__carried")).select(*turns.columns, render_history(F.col("lines")).alias("history"))
    )


def record_turns(answers: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Two log rows per answered question: the user's, then the assistant's."""
    rows = F.array(
        F.struct(F.col(turn_col).alias("turn"), F.lit("user").alias("role"), F.col("user_query").alias("text")),
        F.struct((F.col(turn_col) + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")),
    )
    return answers.select(F.col(conv_col).alias("conv_id"), F.inline(rows))
