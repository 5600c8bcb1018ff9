"""Keep an index up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import keep_first
from ..operators.embed import Encoder
from ..sources.store import IndexStore



def maintain_index(
    documents: DataFrame, path: str, checkpoint: str, name: str, *, encoder: Encoder | None = None, once: bool = True,
    merge: bool = True,
) -> StreamingQuery:
    """Append new documents of every micro-batch to the index at ``path``.

    Ids already stored are skipped, and of repeats inside a micro-batch the
    smallest text stays.  ``name`` labels the batches; use one name per
    checkpoint, so that a repeated batch replaces itself and nothing else.
    Document frequencies are stored raw and turned into idf at query time,
    because every new document changes the idf of all terms.  ``merge`` keeps the
    number of batches small: similar ones become one as soon as enough are there.
    """
    def update(batch: DataFrame, number: int) -> None:
        unique = keep_first(batch, [F.col("doc_id")], order_by="text")
        store = IndexStore(batch.sparkSession, path)
        store.append(unique, f"{name}-{number}", encoder)
        if merge:
            store.compact()

    writer = documents.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
