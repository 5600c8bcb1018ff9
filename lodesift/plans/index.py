"""Index build, and the view of an index that retrieval works on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.documents import build_documents, dense_ids
from ..operators.embed import Encoder, HashedEncoder, embed
from ..operators.blocks import chunk_rows, packed_postings, packed_terms
from ..operators.lexical import Corpus, corpus_statistics, read_corpus
from ..operators.sizing import in_shards
from ..session import materialise
from ..sources.catalog import first_rows
from ..sources.store import IndexStore


@dataclass(frozen=True)
class Index:
    """Tables a retrieval job reads; ``postings(wanted, few)`` gives the posting rows of a table of terms, ``few`` if it may go to every task."""

    documents: DataFrame
    vectors: DataFrame
    terms: DataFrame
    corpus: Corpus
    postings: Callable[..., DataFrame]
    chunks: DataFrame
    encoder: Encoder
    document_shards: list[int] | None = None
    coded: list | None = None
    plain_vectors: DataFrame | None = None


def index_of(docs: DataFrame, encoder: Encoder | None = None) -> Index:
    """An index over a table of documents: texts are read once for the postings and once for the vectors.

    Postings and vocabulary go to the shared folder.  For repeated use build a
    stored index.
    """
    encoder = encoder or HashedEncoder()
    meta = [c for c in docs.columns if c.startswith("meta_")]
    packed = materialise(packed_postings(docs.select("doc_id", "text", *meta)).withColumn("batch", F.lit("")), "packed-postings")
    terms = materialise(packed_terms(packed), "terms")
    return Index(
        documents=docs,
        vectors=embed(docs.select("doc_id", "text", *meta), encoder).drop("text"),
        terms=terms,
        corpus=read_corpus(corpus_statistics(terms)),
        postings=lambda wanted, few=False: packed.join(F.broadcast(wanted) if few else wanted, "term", "left_semi"),
        chunks=chunk_rows(packed),
        encoder=encoder,
    )


def open_index(spark: SparkSession, path: str, encoder: Encoder | None = None) -> Index:
    """A stored index as it is now; pass the encoder it was built with."""
    now = IndexStore(spark, path).snapshot()
    shards = list(now.shards)

    def postings(wanted: DataFrame, few: bool = False) -> DataFrame:
        """Posting rows out of the folders of the wanted terms: partitions are pruned at run time."""
        # True for every token, but Spark prunes at run time only by a side with a filter.
        keyed = in_shards(wanted.filter(F.length("term") > 1), "term", shards)
        keyed = F.broadcast(keyed) if few else keyed
        return now.posting_rows().join(keyed, ["shards", "shard", "term"], "left_semi").drop("shards", "shard")

    return Index(
        documents=now.documents(), vectors=now.vectors(), terms=now.terms(), corpus=now.corpus, postings=postings,
        chunks=now.chunks(), encoder=encoder or HashedEncoder(), document_shards=shards,
        coded=now.coded_vectors(), plain_vectors=now.plain_vectors(),
    )


def build_index(
    startups: DataFrame, path: str, *, encoder: Encoder | None = None, id_col: str | None = None,
    order_by: str = "ordinal", limit: int | None = None, reset: bool = False, batch: str = "initial",
    float_years: bool = False, cells: bool = False,
) -> int:
    """Documents, vectors and postings of a flagged company table; returns the document count.

    Ids are ``doc_<n>`` by position in ``order_by`` unless ``id_col`` names a
    unique column.  ``limit`` takes the first rows only, for trials.  ``cells`` stores
    vectors by cell with codes, for :attr:`~..config.RetrievalConfig.approximate`.
    """
    spark = startups.sparkSession
    chosen = first_rows(startups, order_by, limit)
    if id_col is None:
        numbered = dense_ids(chosen, order_by)
        chosen = numbered.withColumn("__doc_id", F.concat(F.lit("doc_"), F.col("position").cast("string")))
        id_col = "__doc_id"
    docs = build_documents(chosen, id_col, float_years)
    store = IndexStore(spark, path)
    if reset:
        store.clear()
    store.append(docs, batch, encoder, cells=cells)
    return store.count()
