"""A corpus pipeline: language, near duplicates, secrets, mixture, tokens.

Each stage takes documents and returns documents; the last returns token ids.
Documents go only for two reasons: they have no letters, or another document of
their group of near duplicates stays.  Secrets are masked in the text.  The
mixture repeats documents of rare sources and drops none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodesift.llm import bpe, group_matrix, language, mixture, secrets
from lodesift.operators.sizing import broadcast_if_small
from lodesift.session import materialise

VOCABULARY = "byte_bpe_50k.json"
#: How often the mixture may use a document of a rare source.
MAX_REPEATS = 2.0
#: Words of a shingle and percent of the union at which the pipeline takes documents for near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80
BROADCAST_BYTES = 32 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; a missing label becomes the predicted one.  Texts without letters go."""
    model = language.fit(language.split(docs.select("doc_id", "text", "lang")))
    found = language.identify(docs, model)
    written = F.col("text").rlike(r"\p{L}") if not model.languages else F.col("lang_pred") != language.UNKNOWN
    known = F.when(F.col("lang_pred") != language.UNKNOWN, F.col("lang_pred"))
    return found.filter(written).withColumn("lang", F.coalesce("lang", known)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, size: int = 3, percent: int = 90) -> DataFrame:
    """One document of each group that shingles of ``size`` words link at ``percent``: the one of the smallest id.

    Equal rows of one id count as one document; a null id has no group and stays.
    """
    found = materialise(group_matrix.jaccard_components(docs, size=size, percent=percent), "jaccard")
    by_id = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    by_id = materialise(by_id.filter("NOT stays OR rows > 1"), "decisions")
    left = docs.join(broadcast_if_small(by_id.filter("NOT stays").select("doc_id"), BROADCAST_BYTES), "doc_id", "left_anti")
    again = by_id.filter("stays AND rows > 1").select("doc_id")
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(broadcast_if_small(again, BROADCAST_BYTES), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(broadcast_if_small(again, BROADCAST_BYTES), "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """:func:`drop_near_duplicates` at the setting of the pipeline, looser than that of op3."""
    return drop_near_duplicates(spark, docs, sf_dir, NEAR_WORDS, NEAR_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets masked."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budget of their source says, at least once."""
    return mixture.mixed(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and hashes of them and of the text they decode to."""
    done = bpe.encode_texts(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY), decoded="text")
    return done.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("tokens", encode),
]

# Trained models and byte-pair encoding are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
