"""From questions to answers: classify, expand, retrieve, gate, generate, validate.

The retry is unrolled into two passes over tables.  Each pass is written once
(``materialise``), because its rows feed several routes and because injected
models must not run twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import AnswerConfig, SizeLimits
from ..functions.rules import analysis_type, confidence_band, step_after_confidence, step_after_validation, verdict
from ..functions.text import strip
from ..operators import inference as inf
from ..operators import prompts
from ..operators.history import record_turns
from ..operators.rerank import PairModel
from ..session import materialise
from ..sources.external import external_hits, keep_approved
from .index import Index
from .retrieve import retrieve

_SEPARATOR = "\n\n---\n\n"
_CARRIED = ["query_id", "user_query", "history", "analysis_type", "expanded_query", "retry_count"]


# Steps after which a question is done.
_FINAL = ["end", "refuse"]


def _texts(docs: Column) -> Column:
    return F.transform(docs, lambda d: d["text"])


def documents_text(docs: Column, first: int | None = None, separator: str = _SEPARATOR) -> Column:
    """Texts of a rank-ordered hit array as one text."""
    return F.array_join(_texts(F.slice(docs, 1, first) if first else docs), separator)


def classify(state: DataFrame, models: inf.Models) -> DataFrame:
    """Add ``analysis_type``; unknown or failed replies become ``similar``."""
    query = F.col("user_query")
    prompt = prompts.render(prompts.CLASSIFY, history=F.col("history"), query=query)
    replied = inf.with_reply(state, "__label", models.classify, prompt, inf.classify_by_cues(query), store=models.store)
    return replied.withColumn("analysis_type", analysis_type(F.col("__label"))).drop("__label", "__label_error")


def expand(state: DataFrame, models: inf.Models) -> DataFrame:
    """Add ``expanded_query``; a failed call leaves the question as it is."""
    query = F.col("user_query")
    prompt = prompts.render(prompts.EXPAND, history=F.col("history"), query=query)
    replied = inf.with_reply(state, "__text", models.expand, prompt, inf.expand_by_synonyms(query), store=models.store)
    return replied.withColumn("expanded_query", F.coalesce(strip("__text"), query)).drop("__text", "__text_error")


def rewrite(state: DataFrame, models: inf.Models) -> DataFrame:
    """Replace ``expanded_query`` by another try and count the retry."""
    previous = F.col("expanded_query")
    prompt = prompts.render(prompts.REWRITE, query=F.col("user_query"), previous=previous)
    replied = inf.with_reply(state, "__text", models.rewrite, prompt, inf.rewrite_to_core_terms(previous), store=models.store)
    return replied.withColumns({
        "expanded_query": F.coalesce(strip("__text"), previous), "retry_count": F.col("retry_count") + 1,
    }).drop("__text", "__text_error")


def generate(state: DataFrame, models: inf.Models) -> DataFrame:
    """Add ``answer`` (with the disclaimer when confidence is low) and its error."""
    prompt = prompts.prompt_for(F.col("analysis_type"), F.col("user_query"), documents_text(F.col("docs")))
    default = inf.extractive_answer(F.col("analysis_type"), F.col("user_query"), _texts(F.col("docs")))
    replied = inf.with_reply(state, "__text", models.generate, prompt, default, store=models.store)
    return replied.withColumns({
        "answer": prompts.with_disclaimer(F.col("__text"), F.col("confidence")), "error": F.col("__text_error"),
    }).drop("__text", "__text_error")


def validate(state: DataFrame, models: inf.Models, cfg: AnswerConfig) -> DataFrame:
    """Add ``validation_check``."""
    sources = documents_text(F.col("docs"))
    prompt = prompts.render(prompts.VALIDATE, documents=sources, answer=F.col("answer"))
    default = inf.verdict_by_coverage(F.col("answer"), sources, cfg.pass_share)
    replied = inf.with_reply(state, "__verdict", models.validate, prompt, default, store=models.store)
    return replied.withColumn("validation_check", verdict(
        F.size("docs"), F.col("best_score"), F.col("__verdict"), F.col("__verdict_error")
    )).drop("__verdict", "__verdict_error")


def _pass(
    state: DataFrame, index: Index, cfg: AnswerConfig, models: inf.Models, external: bool, label: str, **options,
) -> DataFrame:
    """One retrieve-gate-generate-validate pass, with the next ``step``."""
    asked = state.select(*_CARRIED, F.col("expanded_query").alias("text"))
    found = materialise(retrieve(asked, index, cfg.retrieval, **options).drop("text"), f"{label}-retrieved")
    gated = found.withColumns({
        "confidence": confidence_band(F.col("best_score"), F.size("docs"), cfg.retrieval),
        "web_searched": F.lit(False),
    }).withColumn("step", step_after_confidence(
        F.col("confidence"), F.col("retry_count"), F.col("analysis_type"), cfg.max_retries, external,
    ))
    answered = validate(generate(gated.filter(F.col("step").startswith("generate_")), models), models, cfg)
    answered = answered.withColumn("step", step_after_validation(
        F.col("validation_check"), F.col("confidence"), F.col("retry_count"), cfg.max_retries,
    ))
    rest = gated.filter(~F.col("step").startswith("generate_")).withColumns({
        "answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "validation_check": F.lit(False),
    })
    return materialise(answered.unionByName(rest), f"{label}-answered")


def answer_queries(
    queries: DataFrame, index: Index, cfg: AnswerConfig = AnswerConfig(), *, models: inf.Models = inf.Models(),
    external: DataFrame | None = None, approvals: DataFrame | None = None, where: dict[str, object] | None = None,
    pair_model: PairModel | None = None, limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """Answer a table ``query_id, text [, history]``; one row per query.

    Queries with confidence ``none``, and those that failed validation without
    being of low confidence, are rewritten and tried once more.  What is still
    ``none`` is answered from ``external`` results (``query_id, idx, title,
    url, content, score``), restricted to ``approvals``, or refused.
    """
    options = {"where": where, "pair_model": pair_model, "limits": limits}
    use_external = cfg.external_enabled and external is not None
    history = F.coalesce("history", F.lit("")) if "history" in queries.columns else F.lit("")
    state = queries.select("query_id", F.col("text").alias("user_query"), history.alias("history"))
    state = expand(classify(state, models), models).withColumn("retry_count", F.lit(0))
    if any((models.classify, models.expand)):
        state = materialise(state, "questions")
    done = _pass(state, index, cfg, models, use_external, "first", **options)
    # Later passes hold only what the pass before left over; their number is fixed.
    finished = [done.filter(F.col("step").isin(_FINAL))]
    for attempt in range(cfg.max_retries):
        if done.filter(F.col("step") == "rewrite").isEmpty():
            break
        again = rewrite(done.filter(F.col("step") == "rewrite").select(*_CARRIED), models)
        if models.rewrite:
            again = materialise(again, "rewritten")
        done = _pass(again, index, cfg, models, use_external, f"retry{attempt + 1}", **options)
        finished.append(done.filter(F.col("step").isin(_FINAL)))
    searching = done.filter(F.col("step") == "web_search")
    if use_external and not searching.isEmpty():
        finished.append(_from_external(searching, external, approvals, cfg, models))
    columns = [*_CARRIED, "docs", "best_score", "mean_score", "confidence", "web_searched", "answer",
               "validation_check", "step", "error"]
    result = finished[0].select(*columns)
    for part in finished[1:]:
        result = result.unionByName(part.select(*columns))
    refused = F.when(F.col("step") == "refuse", F.lit(prompts.REFUSAL)).otherwise(F.col("answer"))
    return result.withColumns({"answer": refused, "num_sources": F.size("docs")})


def _from_external(
    state: DataFrame, external: DataFrame, approvals: DataFrame | None, cfg: AnswerConfig, models: inf.Models,
) -> DataFrame:
    # Only results of the queries that need them; at most a handful per query.
    hits = keep_approved(external_hits(external.join(state.select("query_id"), "query_id", "left_semi"),
                                       cfg.external_results), approvals)
    # Text ids are ``web_<n>``; where document ids are numbers, -1, -2, ... stand for them.
    text_ids = isinstance(state.schema["docs"].dataType.elementType["doc_id"].dataType, T.StringType)
    doc_id = F.col("doc_id") if text_ids else (-1 - F.col("idx")).cast("long")
    entry = F.struct(
        (F.col("idx") + 1).alias("rank"), doc_id.alias("doc_id"), "text", "score",
        F.lit(None).cast("double").alias("rerank_score"),
    )
    docs = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("__docs"))
    empty = F.array().cast(state.schema["docs"].dataType)
    joined = state.join(docs, "query_id", "left").withColumns({
        "docs": F.coalesce(F.col("__docs").cast(state.schema["docs"].dataType), empty),
        "confidence": F.lit("low"), "web_searched": F.lit(True),
    }).drop("__docs")
    answered = validate(generate(joined, models), models, cfg)
    return materialise(answered.withColumn("step", F.lit("end")), "external")


def turns_of(answers: DataFrame, conv_col: str = "query_id") -> DataFrame:
    """Log rows of answered questions, numbered from 0 within ``conv_col``."""
    return record_turns(answers.withColumn("turn", F.lit(0)), conv_col)
