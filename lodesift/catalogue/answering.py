"""Decisions, prompts, external hits, answers and the evaluation run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules
from ..operators import inference, prompts
from ..plans.answer import answer_queries, turns_of
from ..operators.replies import ReplyStore
from ..plans.evaluate import evaluate
from ..session import scratch_path
from ..sources.external import external_hits, keep_approved, review_items
from .retrieval import document_index, hybrid_ctes
from .tables import SPACES, table

# A query state per document: every mix of score, hits, retries and verdict occurs.
STATES = """
SELECT doc_id AS query_id, CAST(n_chars % 150 AS DOUBLE) / 1000 - 0.01 AS best_score, CAST(doc_id % 4 AS INTEGER) AS n_docs,
  CAST(n_chars % 2 AS INTEGER) AS retry_count,
  CASE doc_id % 7 WHEN 0 THEN 'SWOT ' WHEN 1 THEN 'competitor' WHEN 2 THEN concat('swot', chr(10)) WHEN 3 THEN 'ecosystem'
    WHEN 4 THEN '' WHEN 5 THEN NULL ELSE 'comparison' END AS label,
  CASE n_chars % 5 WHEN 0 THEN 'pass' WHEN 1 THEN concat(chr(9), 'Pass ', chr(10)) WHEN 2 THEN 'pass.' WHEN 3 THEN 'fail' END AS reply,
  CASE WHEN n_chars % 5 = 4 AND doc_id % 2 = 0 THEN 'timeout' END AS reply_error
FROM documents
"""

# Questions made of the texts, with cues and known words in front of some.
ASKED = """
SELECT doc_id AS query_id, concat(CASE doc_id % 8 WHEN 0 THEN 'SWOT of ' WHEN 1 THEN 'Who competes with ' WHEN 2 THEN 'Compare fintech and '
  WHEN 3 THEN 'Map the ecosystem of AI ' WHEN 4 THEN 'healthcare SaaS in ' WHEN 5 THEN 'crypto vs edtech ' ELSE '' END, text) AS query
FROM documents
"""


# Questions for every route: each analysis type, nothing known (retry, then external results or refusal), little known (low
# confidence), and much that no source covers.
ROUTED = """
SELECT item_id AS query_id, CASE item_id % 8 WHEN 0 THEN text WHEN 1 THEN concat('SWOT of ', text)
  WHEN 2 THEN concat('zq', item_id, 'x xqzv wwzqj vvjq') WHEN 3 THEN concat('Compare fintech and ', text)
  WHEN 4 THEN concat('Who competes with ', text) WHEN 5 THEN concat('Map the ecosystem: ', text)
  WHEN 6 THEN concat('qqaj qqbj qqcj qqdj qqej qqfj qqgj ', regexp_extract(text, '^[^ ]*', 0))
  ELSE concat('zzaj zzbj zzcj zzdj zzej zzfj zzgj zzhj zzij zzjj zzkj zzlj zzmj zznj zzoj zzpj zzqj zzrj ', text) END AS text
FROM benchmark
"""


def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROUTED.replace("FROM benchmark", "FROM {benchmark}"), benchmark=table(spark, sf_dir, "benchmark"))


def _documents_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _documents_sql(spark, sf_dir, STATES)
    state = state.withColumns({
        "analysis_type": rules.analysis_type(F.col("label")),
        "confidence": rules.confidence_band(F.col("best_score"), F.col("n_docs")),
        "validation_check": rules.verdict(F.col("n_docs"), F.col("best_score"), F.col("reply"), F.col("reply_error")),
    })
    gate = (F.col("confidence"), F.col("retry_count"), F.col("analysis_type"), 1)
    return state.select(
        "query_id", "analysis_type", "confidence", "validation_check",
        rules.step_after_confidence(*gate, external=True).alias("after_gate"),
        rules.step_after_confidence(*gate, external=False).alias("after_gate_offline"),
        rules.step_after_validation(F.col("validation_check"), F.col("confidence"), F.col("retry_count"), 1)
        .alias("after_validation"),
        rules.generation_step(F.col("analysis_type")).alias("after_external"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _documents_sql(spark, sf_dir, ASKED)
    return asked.select("query_id", rules.analysis_type(inference.classify_by_cues(F.col("query"))).alias("analysis_type"))


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _documents_sql(spark, sf_dir, ASKED)
    return asked.select("query_id", inference.expand_by_synonyms(F.col("query")).alias("expanded_query"))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _documents_sql(spark, sf_dir, ASKED)
    return asked.select("query_id", inference.rewrite_to_core_terms(F.col("query")).alias("rewritten_query"))


def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.element_at(F.array(*[F.lit(t) for t in [*prompts.TEMPLATES, "unknown"]]), (F.col("doc_id") % 7 + 1).cast("int"))
        .alias("analysis_type"), F.col("source").alias("query"), F.col("text").alias("documents"),
    )
    return prompts.add_prompts(docs, on_unknown="report").select("doc_id", "analysis_type", "prompt", "prompt_error")


_PAGE_ROWS = """
SELECT page_id % 40 AS query_id, CAST(page_id // 40 AS INTEGER) AS idx, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  url, html AS content, CAST(page_id % 10 AS DOUBLE) / 10 AS score FROM pages
"""


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dealt to forty questions as their external results."""
    sql = _PAGE_ROWS.replace("page_id // 40", "page_id div 40").replace("FROM pages", "FROM {pages}")
    return spark.sql(sql, pages=table(spark, sf_dir, "pages"))


def external_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_hits(page_results(spark, sf_dir)).select(
        "query_id", "idx", "doc_id", "text", F.col("metadata")["source"].alias("source"),
        F.col("metadata")["url"].alias("url"), F.col("metadata")["title"].alias("title"), "score", "confidence", "web_searched",
    )


def approved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even positions approved; every fifth question approves everything."""
    rows = page_results(spark, sf_dir)
    approvals = rows.filter(F.col("idx") % 2 == 0).select(
        "query_id", F.when(F.col("query_id") % 5 != 0, F.col("idx")).alias("idx")
    )
    return review_items(keep_approved(external_hits(rows), approvals))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = answer_queries(routed_questions(spark, sf_dir), document_index(spark, sf_dir), external=page_results(spark, sf_dir))
    return done.select(
        "query_id", "analysis_type", "expanded_query", "retry_count", "confidence", "web_searched", "num_sources",
        "best_score", "answer", "validation_check",
    )


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_of(answer_queries(routed_questions(spark, sf_dir), document_index(spark, sf_dir)))


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all routes as evaluation items, their own first words expected, their last one unwanted."""
    from ..functions.text import tokens

    words = tokens("text")
    items = routed_questions(spark, sf_dir).select(
        F.col("query_id").alias("id"), F.col("text").alias("query"), F.lit("similar").alias("analysis_type"),
        F.slice(words, 1, 3).alias("expected_domains"), F.slice(words, -1, 1).alias("bad_results"),
        F.array(F.lit("Similar Companies")).alias("expected_sections"), F.lit("benchmark text").alias("description"),
    )
    return evaluate(items, document_index(spark, sf_dir))


def _shout(prompts: list[str]) -> list[str]:
    """A model that always says the same to the same prompt."""
    return [p.upper() for p in prompts]


def stored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over overlapping texts: how many prompts reached the model in each, and how many rows got the right reply."""
    store = ReplyStore(spark, scratch_path(spark, "replies"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    replies = [store.complete(docs.filter(part), F.col("text"), _shout, "reply") for part in ("doc_id % 3 <> 0", "doc_id % 3 <> 1")]
    right = [r.agg(F.lit(n).alias("run"), F.count_if(F.col("reply") == F.upper("text")).alias("right_replies")) for n, r in enumerate(replies, 1)]
    return store.runs().join(right[0].unionByName(right[1]), "run").select(F.col("run").cast("int").alias("run"), "prompts", "right_replies")


def _short(prompts: list[str]) -> list[str]:
    return [p.rstrip()[-200:] for p in prompts]


def _passes(prompts: list[str]) -> list[str]:
    return ["pass"] * len(prompts)


def answers_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions answered twice by injected models: no prompt reaches them in the second run."""
    store = ReplyStore(spark, scratch_path(spark, "replies"))
    models, index = inference.Models(generate=_short, validate=_passes, store=store), document_index(spark, sf_dir)
    for _ in range(2):
        done = answer_queries(routed_questions(spark, sf_dir), index, external=page_results(spark, sf_dir), models=models)
        answered = done.agg(F.count_if(F.col("answer").isNotNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    half = store.runs().agg(F.max("run")).first()[0] // 2
    again = store.runs().agg(F.sum(F.when(F.col("run") > half, F.col("prompts")).otherwise(0)).alias("asked_again"))
    return answered.join(again)


QUERIES = {f.__name__: f for f in (
    routes, classified, expanded, rewritten, rendered_prompts, external_results, approved_results, answers, answer_log,
    evaluation_run, stored_replies, answers_from_store,
)}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cue_case() -> str:
    whens = []
    for label, cues in inference.CLASSIFIER_CUES.items():
        tests = " OR ".join(f"contains(lower(query), {_sql_text(c)})" for c in cues)
        whens.append(f"WHEN {tests} THEN '{label}'")
    return f"CASE {' '.join(whens)} ELSE 'similar' END"


_KNOWN = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in inference.SYNONYMS.items())
_WORDS = """
words AS (SELECT query_id, query, unnest(w) AS term, generate_subscripts(w, 1) AS pos
  FROM (SELECT query_id, query, regexp_extract_all(lower(query), '[a-z0-9]{2,}') AS w FROM asked)),
firsts AS (SELECT query_id, term, min(pos) AS pos FROM words GROUP BY ALL)"""


def _prompt_case() -> str:
    whens = []
    for name, template in prompts.TEMPLATES.items():
        text = _sql_text(template).replace("{documents}", "' || text || '").replace("{query}", "' || source || '")
        whens.append(f"WHEN '{name}' THEN {text}")
    return f"CASE t {' '.join(whens)} END"


_TYPES = ", ".join(f"'{t}'" for t in [*prompts.TEMPLATES, "unknown"])
_EXTERNAL = f"""
WITH r AS ({_PAGE_ROWS}),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idx) - 1 AS n FROM r QUALIFY n < 5)"""

# What a question's route comes to, in SQL: two passes of hybrid retrieval, answers from first lines, a verdict by covered words.
_HEADINGS = "CASE analysis_type " + " ".join(
    f"WHEN '{name}' THEN {_sql_text(chr(10).join(f'## {t}' for t in titles))}" for name, titles in inference.SECTIONS.items()) + " END"


def _covered(of: str, by: str) -> str:
    """Share of the distinct tokens of one text that occur in another."""
    mine, other = (f"regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}')" for x in (of, by))
    return f"CASE WHEN len({mine}) > 0 THEN len(list_intersect({mine}, {other}))::DOUBLE / len(list_distinct({mine})) ELSE 0.0::DOUBLE END"


def _attempt(name: str, state: str) -> str:
    """One pass over ``state`` (query_id, query, analysis_type, expanded_query, retry_count)."""
    hits = hybrid_ctes().replace("benchmark", f"{name}_asked")
    return f"""
{name}_asked AS (SELECT query_id AS item_id, expanded_query AS text FROM {state}),
{name}_hits AS (WITH {hits} SELECT * FROM hits),
{name}_found AS (SELECT query_id, list(text ORDER BY rank) AS texts, coalesce(max(rerank_score), 1.0) AS best_score
  FROM {name}_hits JOIN documents USING (doc_id) GROUP BY 1),
{name}_gated AS (SELECT s.*, coalesce(texts, []) AS texts, coalesce(best_score, 1.0) AS best_score,
    CASE WHEN texts IS NULL THEN 'none' WHEN best_score < 0.02 THEN 'none' WHEN best_score < 0.1 THEN 'low' ELSE 'high' END AS confidence
  FROM {state} s LEFT JOIN {name}_found USING (query_id)),
{_generated(f"{name}_done", f"{name}_gated", "confidence <> 'none'")}"""


def _generated(name: str, gated: str, answering: str) -> str:
    line = "list_transform(texts, lambda t: '- ' || split_part(t, chr(10), 1))"
    sources = "array_to_string(texts, chr(10) || chr(10) || '---' || chr(10) || chr(10))"
    return f"""
{name}_answer AS (SELECT *, CASE WHEN {answering} THEN CASE WHEN confidence = 'low' THEN {_sql_text(prompts.DISCLAIMER)} ELSE '' END
    || 'Question: ' || query || chr(10) || chr(10) || {_HEADINGS} || chr(10) || chr(10) || 'Sources' || chr(10) || array_to_string({line}, chr(10)) END AS answer
  FROM {gated}),
{name} AS (SELECT *, CASE WHEN answer IS NULL OR len(texts) = 0 OR best_score <= 0 THEN false ELSE {_covered('answer', sources)} >= 0.5 END AS validation_check
  FROM {name}_answer)"""


def _routed(external: bool) -> str:
    """Common table expressions up to ``final``, a row per question."""
    columns = "query_id, query, analysis_type, expanded_query, retry_count, texts, best_score, confidence, answer, validation_check"
    searched = f"""
web AS (SELECT s.* EXCLUDE (texts, confidence, answer, validation_check), coalesce(found.texts, []) AS texts, 'low' AS confidence
  FROM again_done s LEFT JOIN (SELECT query_id, list(content ORDER BY n) AS texts FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idx) - 1 AS n FROM ({_PAGE_ROWS}) QUALIFY n < 5) GROUP BY 1) found USING (query_id)
  WHERE s.confidence = 'none'), {_generated('web_done', 'web', 'true')},
left_over AS (SELECT {columns}, true AS web_searched FROM web_done)""" if external else f"""
left_over AS (SELECT {columns.replace('answer', f"{_sql_text(prompts.REFUSAL)} AS answer")}, false AS web_searched
  FROM again_done WHERE confidence = 'none')"""
    return f"""
asked AS (SELECT query_id, text AS query FROM ({ROUTED})), {_WORDS}, known(term, extra) AS (VALUES {_KNOWN}),
more AS (SELECT query_id, string_agg(extra, ' ' ORDER BY pos) AS extra FROM firsts JOIN known USING (term) GROUP BY 1),
state AS (SELECT query_id, query, {_cue_case()} AS analysis_type, CASE WHEN extra IS NULL THEN query ELSE query || ' ' || extra END AS expanded_query,
    0 AS retry_count FROM asked LEFT JOIN more USING (query_id)),
{_attempt('one', 'state')},
failed AS (SELECT * FROM one_done WHERE confidence = 'none' OR (NOT validation_check AND confidence <> 'low')),
core AS (SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS core FROM (
    SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos
      FROM (SELECT query_id, regexp_extract_all(lower(expanded_query), '[a-z0-9]{{2,}}') AS w FROM failed)) WHERE length(term) >= 4 GROUP BY ALL) GROUP BY 1),
state2 AS (SELECT query_id, query, analysis_type, coalesce(core, expanded_query) AS expanded_query, 1 AS retry_count FROM failed LEFT JOIN core USING (query_id)),
{_attempt('again', 'state2')}, {searched},
final AS (SELECT {columns}, false AS web_searched FROM one_done WHERE query_id NOT IN (SELECT query_id FROM failed)
  UNION ALL SELECT {columns}, false FROM again_done WHERE confidence <> 'none' UNION ALL SELECT {columns}, web_searched FROM left_over)"""


_FIVE = "array_to_string(texts[:5], chr(10) || '---' || chr(10))"
_TOKENS = "regexp_extract_all(lower(query), '[a-z0-9]{2,}')"

ORACLES = {
    "stored_replies": """
WITH one AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL),
two AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 <> 1 AND text IS NOT NULL EXCEPT SELECT text FROM one)
SELECT 1 AS run, (SELECT count(*) FROM one) AS prompts, (SELECT count(text) FROM documents WHERE doc_id % 3 <> 0) AS right_replies
UNION ALL SELECT 2, (SELECT count(*) FROM two), (SELECT count(text) FROM documents WHERE doc_id % 3 <> 1)""",
    "answers_from_store": "SELECT count(*) AS answered, 0::BIGINT AS failed, 0::BIGINT AS asked_again FROM benchmark",
    "answers": f"""WITH {_routed(True)}
SELECT query_id, analysis_type, expanded_query, retry_count::INTEGER AS retry_count, confidence, web_searched,
  len(texts)::INTEGER AS num_sources, best_score, answer, validation_check FROM final""",
    "answer_log": f"""WITH {_routed(False)}
SELECT query_id AS conv_id, 0 AS turn, 'user' AS role, query AS text FROM final UNION ALL
SELECT query_id, 1, 'assistant', answer FROM final""",
    "evaluation_run": f"""WITH {_routed(False)}
SELECT query_id AS id, query, 'similar' AS analysis_type, CAST(NULL AS VARCHAR) AS model_name, 'benchmark text' AS description,
  CASE WHEN length(answer) > 200 THEN substring(answer, 1, 200) || '…' ELSE answer END AS answer_preview, len(texts)::INTEGER AS num_sources,
  round({_covered('query', _FIVE)}, 3) AS context_relevancy, round({_covered('answer', _FIVE)}, 3) AS groundedness,
  round({_covered('query', 'answer')}, 3) AS answer_relevancy,
  CASE WHEN len(texts) > 0 AND len({_TOKENS}) > 0 THEN round(len(list_filter(texts, lambda t: len(list_filter(({_TOKENS})[:3], lambda d: contains(lower(t), d))) > 0))::DOUBLE / len(texts), 3)
    ELSE 0.0::DOUBLE END AS precision_at_k,
  CASE WHEN contains(lower(answer), 'similar companies') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS structure_score,
  CASE WHEN len(list_filter(({_TOKENS})[-1:], lambda d: contains(lower(array_to_string(texts, ' ')), d))) > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS bad_result_check,
  CAST(NULL AS DOUBLE) AS latency_seconds, 2 * len(regexp_extract_all(answer, '{SPACES.replace('[', '[^', 1)}')) AS total_tokens, false AS judge_failed,
  CAST(NULL AS VARCHAR) AS error FROM final""",
    "routes": f"""
WITH s AS ({STATES}),
t AS (SELECT *, CASE WHEN lower(trim(label, ' ' || chr(9) || chr(10))) IN ('similar', 'swot', 'competitor', 'comparison', 'ecosystem')
    THEN lower(trim(label, ' ' || chr(9) || chr(10))) ELSE 'similar' END AS analysis_type,
  CASE WHEN n_docs = 0 THEN 'none' WHEN best_score < 0.02::DOUBLE THEN 'none' WHEN best_score < 0.1::DOUBLE THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN n_docs = 0 THEN false WHEN best_score <= 0 THEN false WHEN reply_error IS NOT NULL THEN true
    ELSE coalesce(lower(trim(reply, ' ' || chr(9) || chr(10))) = 'pass', false) END AS validation_check FROM s)
SELECT query_id, analysis_type, confidence, validation_check,
  CASE WHEN confidence <> 'none' THEN 'generate_' || analysis_type WHEN retry_count < 1 THEN 'rewrite' ELSE 'web_search' END AS after_gate,
  CASE WHEN confidence <> 'none' THEN 'generate_' || analysis_type WHEN retry_count < 1 THEN 'rewrite' ELSE 'refuse' END AS after_gate_offline,
  CASE WHEN validation_check OR confidence = 'low' OR retry_count >= 1 THEN 'end' ELSE 'rewrite' END AS after_validation,
  'generate_' || analysis_type AS after_external FROM t""",
    "classified": f"WITH asked AS ({ASKED}) SELECT query_id, {_cue_case()} AS analysis_type FROM asked",
    "expanded": f"""
WITH asked AS ({ASKED}), {_WORDS}, known(term, extra) AS (VALUES {_KNOWN}),
more AS (SELECT query_id, string_agg(extra, ' ' ORDER BY pos) AS extra FROM firsts JOIN known USING (term) GROUP BY 1)
SELECT query_id, CASE WHEN extra IS NULL THEN query ELSE query || ' ' || extra END AS expanded_query
FROM asked LEFT JOIN more USING (query_id)""",
    "rewritten": f"""
WITH asked AS ({ASKED}), {_WORDS},
core AS (SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS core FROM firsts WHERE length(term) >= 4 GROUP BY 1)
SELECT query_id, coalesce(core, query) AS rewritten_query FROM asked LEFT JOIN core USING (query_id)""",
    "rendered_prompts": f"""
SELECT doc_id, t AS analysis_type, {_prompt_case()} AS prompt,
  CASE WHEN t = 'unknown' THEN 'unknown analysis type: unknown' END AS prompt_error
FROM (SELECT *, [{_TYPES}][doc_id % 7 + 1] AS t FROM documents)""",
    "external_results": f"""{_EXTERNAL}
SELECT query_id, n::INTEGER AS idx, 'web_' || n::VARCHAR AS doc_id, content AS text, 'web' AS source, url, title, score,
  'low' AS confidence, true AS web_searched FROM e""",
    "approved_results": f"""{_EXTERNAL}
SELECT query_id, n::INTEGER AS idx, CASE WHEN title <> '' THEN title ELSE 'Result ' || (n + 1)::VARCHAR END AS title, url,
  substring(content, 1, 200) AS snippet FROM e WHERE query_id % 5 = 0 OR n % 2 = 0""",
}
