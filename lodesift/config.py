"""Parameters of every stage, as frozen dataclasses with the default values."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# These decide results and therefore stay exactly as they are.
# ---------------------------------------------------------------------------

ACCELERATOR_RENAMES = {
    "company_id": "startup_id",
    "company_name": "name",
    "year_founded": "founded_year",
}
REGISTRY_RENAMES = {"id": "startup_id", "country_code": "country"}

ACCELERATOR_SOURCE = "YC"
REGISTRY_SOURCE = "Crunchbase"
REGISTRY_ENTITY_TYPE = "Company"

STARTUP_COLUMNS = [
    "startup_id", "name", "description", "industry",
    "tags", "country", "founded_year", "source",
]

DOCUMENT_FIELDS = [
    ("name", "Name"),
    ("industry", "Industry"),
    ("tags", "Tags"),
    ("country", "Country"),
    ("founded_year", "Founded"),
    ("description", "Description"),
]
METADATA_FIELDS = ["startup_id", "source", "is_suspicious", "country", "founded_year"]

PLACEHOLDER_NAMES = r"^(test|example|demo|sample|company\d*)$"

ANALYSIS_TYPES = ["similar", "swot", "competitor", "comparison", "ecosystem"]
REPORT_TYPES = ["similar", "swot", "competitor", "comparison", "ecosystem", "auto"]

# Headings that an answer of each type is expected to have.
SECTIONS = {
    "similar": ["Similar Companies"],
    "swot": ["Strengths", "Weaknesses", "Opportunities", "Threats"],
    "competitor": ["Direct Competitors", "Indirect Competitors"],
    "comparison": ["Comparison"],
    "ecosystem": ["Ecosystem Overview", "Key Players"],
}

# Missing-value tokens of the default reader, and of a pandas-compatible one.
MISSING_TOKENS = ("",)
PANDAS_MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


# The default thresholds and weights of the classes below are fixed values as well.

@dataclass(frozen=True)
class CleanConfig:
    min_description: int = 10        # descriptions of this length or less go
    short_name: int = 2
    short_description: int = 20
    oldest_year: int = 1900
    future_years: int = 1
    date_format: str = "yyyy-MM-dd"


@dataclass(frozen=True)
class LexicalConfig:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    top_k: int = 20


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 5                   # hits handed to generation
    candidates: int = 20             # semantic list and fused list length
    lexical: LexicalConfig = LexicalConfig()
    rrf_k: int = 60
    semantic_weight: float = 1.0
    lexical_weight: float = 0.4
    hybrid: bool = True
    rerank: bool = True
    guardrails: bool = True
    hard_threshold: float = 0.02
    soft_threshold: float = 0.10
    decimals: int = 6                # scores are rounded before ranking
    approximate: bool = False        # search cells and codes where an index has them


@dataclass(frozen=True)
class AnswerConfig:
    retrieval: RetrievalConfig = RetrievalConfig()
    max_retries: int = 1
    external_enabled: bool = True
    external_results: int = 5
    memory_window: int = 6
    assistant_chars: int = 300
    pass_share: float = 0.5          # default groundedness verdict


@dataclass(frozen=True)
class EmbeddingConfig:
    dim: int = 384
    batch_rows: int = 500


@dataclass(frozen=True)
class SizeLimits:
    """Bounds that decide between a broadcast and a shuffled plan."""

    broadcast_bytes: int = 64 << 20
    block_rows: int = 4096           # rows of one side of a similarity block
