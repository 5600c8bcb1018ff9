"""Text models as batch operators over tables, and their default stand-ins.

A model is a function from a list of prompts to a list of replies.  Where none
is given, a deterministic rule written as Spark expressions takes its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import SECTIONS
from ..functions.text import tokens

TextModel = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Models:
    """Injected text models; ``None`` selects the default rule."""

    classify: TextModel | None = None
    expand: TextModel | None = None
    rewrite: TextModel | None = None
    generate: TextModel | None = None
    validate: TextModel | None = None
    judge: TextModel | None = None
    #: Stored replies (``operators.replies.ReplyStore``): distinct new prompts only reach the models.
    store: object | None = None


def batch_complete(
    df: DataFrame, prompt: Column, model: TextModel, out: str, error: str | None = None, batch_rows: int = 64,
) -> DataFrame:
    """Add the reply to ``prompt`` and, where a call failed, the error text.

    A failing batch is repeated row by row, so one bad prompt costs only its
    own row.  The model runs inside tasks that may be retried: it has to give
    the same reply again or at least do no harm when called twice.
    """
    error = error or f"{out}_error"
    df = df.withColumn("__prompt", prompt)
    schema = T.StructType([
        *[f for f in df.schema.fields if f.name != "__prompt"],
        T.StructField(out, T.StringType()), T.StructField(error, T.StringType()),
    ])

    def call(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            replies = model(prompts)
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            return [(r, None) for r in replies]
        except Exception as exc:            # reported per row, never swallowed
            if len(prompts) == 1:
                return [(None, f"{type(exc).__name__}: {exc}")]
            return [pair for p in prompts for pair in call([p])]

    at = df.columns.index("__prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Prompts and replies of one call are held as Python texts, not those of a whole batch.
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                replies = call(part.column(at).to_pylist())
                columns = [c for n, c in enumerate(part.columns) if n != at]
                told = [pa.array([pair[n] for pair in replies], pa.string(), from_pandas=True) for n in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *told], names=schema.names)

    return df.mapInArrow(run, schema)


def with_reply(
    df: DataFrame, out: str, model: TextModel | None, prompt: Column, default: Column, batch_rows: int = 64,
    store: object | None = None,
) -> DataFrame:
    """Reply and error columns, from the model (or its stored replies) or from the default rule."""
    if model is None:
        return df.withColumns({out: default, f"{out}_error": F.lit(None).cast("string")})
    if store is not None:
        return store.complete(df, prompt, model, out, batch_rows=batch_rows)
    return batch_complete(df, prompt, model, out, batch_rows=batch_rows)


# ---------------------------------------------------------------------------
# Default rules
# ---------------------------------------------------------------------------

CLASSIFIER_CUES = {
    "swot": ["swot", "strengths", "weaknesses"],
    "competitor": ["compet", "rival"],
    "comparison": ["compar", " vs ", "versus", "side-by-side"],
    "ecosystem": ["ecosystem", "landscape", "sub-segment", "trend"],
}

SYNONYMS = {
    "fintech": "payment banking billing",
    "healthcare": "medical health clinical",
    "edtech": "education learning course",
    "ecommerce": "online shopping retail",
    "ai": "artificial intelligence machine learning",
    "crypto": "blockchain decentralized web3",
    "proptech": "real estate property housing",
    "agtech": "agriculture farming crop",
    "saas": "software subscription cloud",
    "logistics": "delivery transport shipping",
}


def classify_by_cues(query: Column) -> Column:
    text = F.lower(query)
    rule = None
    for label, cues in CLASSIFIER_CUES.items():
        hit = F.lit(False)
        for cue in cues:
            hit = hit | F.contains(text, F.lit(cue))
        rule = F.when(hit, label) if rule is None else rule.when(hit, label)
    return rule.otherwise("similar")


def expand_by_synonyms(query: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The query followed by the synonyms of its words."""
    pairs = [F.lit(x) for pair in (synonyms or SYNONYMS).items() for x in pair]
    known = F.create_map(*pairs)
    extra = F.array_compact(F.transform(F.array_distinct(tokens(query)), lambda t: F.try_element_at(known, t)))
    return F.when(F.size(extra) > 0, F.concat(query, F.lit(" "), F.array_join(extra, " "))).otherwise(query)


def rewrite_to_core_terms(previous: Column, shortest: int = 4) -> Column:
    """The distinct words of ``shortest`` characters or more of the previous query, or the query itself."""
    core = F.filter(F.array_distinct(tokens(previous)), lambda t: F.length(t) >= shortest)
    return F.when(F.size(core) > 0, F.array_join(core, " ")).otherwise(previous)


def extractive_answer(analysis_type: Column, query: Column, texts: Column) -> Column:
    """Headings of the analysis type, then the first line of each source."""
    headings = F.create_map(*[
        F.lit(x) for name, titles in SECTIONS.items()
        for x in (name, "\n".join(f"## {title}" for title in titles))
    ])
    bullets = F.transform(texts, lambda t: F.concat(F.lit("- "), F.split_part(t, F.lit("\n"), F.lit(1))))
    return F.concat(
        F.lit("Question: "), query, F.lit("\n\n"), F.try_element_at(headings, analysis_type),
        F.lit("\n\nSources\n"), F.array_join(bullets, "\n"),
    )


def token_coverage(of: Column, by: Column) -> Column:
    """Share of the distinct tokens of ``of`` that occur in ``by``; none is 0."""
    wanted = F.array_distinct(tokens(of))
    found = F.size(F.array_intersect(wanted, tokens(by)))
    return F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(F.lit(0.0))


def verdict_by_coverage(answer: Column, sources: Column, share: float) -> Column:
    return F.when(token_coverage(answer, sources) >= share, "pass").otherwise("fail")


def score_text(c: Column) -> Column:
    """A share as a judge would write it."""
    return F.format_string("%.3f", c)
