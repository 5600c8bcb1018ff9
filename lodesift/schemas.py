"""Schemas of the tables that travel between stages."""

from pyspark.sql import types as T


def _struct(names: str = "", /, **typed: T.DataType) -> T.StructType:
    """Text columns by name, then typed ones."""
    fields = [T.StructField(name, T.StringType()) for name in names.split()]
    return T.StructType(fields + [T.StructField(name, dtype) for name, dtype in typed.items()])


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())

ACCELERATOR_RAW = _struct(
    "company_id company_name short_description long_description tags country year_founded"
)
REGISTRY_RAW = _struct(
    "id entity_type name category_code founded_at country_code short_description description overview tag_list"
)
STARTUP = _struct("startup_id name description industry tags country", founded_year=_INT, source=_TEXT)
DOCUMENT = _struct("doc_id text", metadata=T.MapType(_TEXT, _TEXT))
HIT = _struct(query_id=_LONG, list_id=_INT, rank=_INT, doc_id=_TEXT, score=_DOUBLE)
TURN = _struct(conv_id=_LONG, turn=_LONG, role=_TEXT, text=_TEXT)
EXTERNAL_HIT = _struct(query_id=_LONG, idx=_INT, title=_TEXT, url=_TEXT, content=_TEXT, score=_DOUBLE)
EVAL_ITEM = _struct(
    "id query analysis_type", expected_domains=_TEXTS, bad_results=_TEXTS, expected_sections=_TEXTS, description=_TEXT
)
EVAL_RESULT = _struct(
    "id query analysis_type model_name description answer_preview",
    num_sources=_INT, context_relevancy=_DOUBLE, groundedness=_DOUBLE, answer_relevancy=_DOUBLE,
    precision_at_k=_DOUBLE, structure_score=_DOUBLE, bad_result_check=_DOUBLE, latency_seconds=_DOUBLE,
    total_tokens=_LONG, error=_TEXT,
)
_AVERAGES = {f"avg_{n}": _DOUBLE for n in ("context_relevancy", "groundedness", "answer_relevancy", "precision_at_k")}
EVAL_RUN = _struct(
    summary=_struct(
        "run_date model_name llm_provider",
        total_queries=_LONG, successful=_LONG, failed=_LONG, total_time_seconds=_DOUBLE, avg_latency_seconds=_DOUBLE,
        **_AVERAGES, avg_structure_score=_DOUBLE, avg_bad_result_check=_DOUBLE,
        by_analysis_type=T.MapType(_TEXT, _struct(count=_LONG, **_AVERAGES)), error=_TEXT,
    ),
    results=T.ArrayType(EVAL_RESULT),
)
