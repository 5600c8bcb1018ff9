"""Prompt texts and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROLE = "You are an analyst of young companies. Use only the company records given below and say so where they do not suffice.\n\n"
_TAIL = "\n\nRecords:\n{documents}\n\nQuestion: {query}"

TEMPLATES = {
    "auto": ROLE + "Answer in whatever form suits the question best." + _TAIL,
    "similar": ROLE + "List the companies that resemble what is asked for and explain each match." + _TAIL,
    "swot": ROLE + "Write four sections: ## Strengths, ## Weaknesses, ## Opportunities, ## Threats." + _TAIL,
    "competitor": ROLE + "Write the sections ## Direct Competitors, ## Indirect Competitors and ## Positioning." + _TAIL,
    "comparison": ROLE + "Compare the companies in a table (industry, country, founded, focus), then in words." + _TAIL,
    "ecosystem": ROLE + "Write the sections ## Ecosystem Overview, ## Key Players, ## Segments and ## Gaps." + _TAIL,
}

CLASSIFY = (
    "Name the analysis that fits the question. Reply with one word: similar, swot, competitor, comparison or "
    "ecosystem.\n\n{history}Question: {query}\nAnalysis:"
)
EXPAND = (
    "Restate the question as search terms: domain, industry, products, technology. Resolve references to the "
    "conversation. Reply with the terms only.\n\n{history}Question: {query}\nTerms:"
)
REWRITE = (
    "The search below found nothing useful. Write another one with different words for the same question. "
    "Reply with the search only.\n\nQuestion: {query}\nEarlier search: {previous}\nNew search:"
)
VALIDATE = (
    "Check the answer against the sources. Reply 'pass' if every claim is supported by them, otherwise 'fail'."
    "\n\nSources:\n{documents}\n\nAnswer:\n{answer}\n\nVerdict:"
)
JUDGE_CONTEXT = "Rate from 0.0 to 1.0 how relevant the records are to the question. Reply with the number.\n\nQuestion: {query}\n\nRecords:\n{documents}\n\nScore:"
JUDGE_GROUNDED = "Rate from 0.0 to 1.0 how well the records support the answer. Reply with the number.\n\nRecords:\n{documents}\n\nAnswer:\n{answer}\n\nScore:"
JUDGE_ANSWER = "Rate from 0.0 to 1.0 how well the answer serves the question as a '{type}' analysis. Reply with the number.\n\nQuestion: {query}\n\nAnswer:\n{answer}\n\nScore:"

REFUSAL = (
    "There is not enough matching information in the records to answer this. The topic may not be covered, or the "
    "question may be too broad: please rephrase it."
)
DISCLAIMER = "Note: low confidence. The records found may not fit the question well; check the following with care.\n\n---\n\n"


def render(template: str | Column, **values: Column) -> Column:
    """Fill ``{name}`` slots of a template.

    The template is cut at its slots first, so slot-like text inside a value
    stays as it is.
    """
    if isinstance(template, str):
        parts: list[Column] = []
        rest = template
        while rest:
            slots = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
            if not slots:
                parts.append(F.lit(rest))
                break
            at, name = min(slots)
            parts += [F.lit(rest[:at]), F.coalesce(values[name], F.lit(""))]
            rest = rest[at + len(name) + 2:]
        return F.concat(*parts)
    raise TypeError("render takes a template text; use prompt_for for templates by type")


def prompt_for(analysis_type: Column, query: Column, documents: Column) -> Column:
    """Generation prompt by analysis type; null for an unknown type."""
    rule = None
    for name, template in TEMPLATES.items():
        text = render(template, query=query, documents=documents)
        rule = F.when(analysis_type == name, text) if rule is None else rule.when(analysis_type == name, text)
    return rule


def add_prompts(df: DataFrame, on_unknown: str = "error") -> DataFrame:
    """Add ``prompt`` from ``analysis_type, query, documents``.

    Unknown types stop the job (``error``) or end up with a null prompt and
    a filled ``prompt_error`` (``report``).
    """
    prompt = prompt_for(F.col("analysis_type"), F.col("query"), F.col("documents"))
    message = F.concat(F.lit("unknown analysis type: "), F.coalesce("analysis_type", F.lit("null")))
    if on_unknown == "error":
        return df.withColumn("prompt", F.coalesce(prompt, F.raise_error(message).cast("string")))
    return df.withColumn("prompt", prompt).withColumn("prompt_error", F.when(F.col("prompt").isNull(), message))


def with_disclaimer(answer: Column, confidence: Column) -> Column:
    return F.when(confidence == "low", F.concat(F.lit(DISCLAIMER), answer)).otherwise(answer)
