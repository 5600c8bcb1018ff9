"""The index as a folder of Parquet tables.

``documents`` (id, text, metadata), ``vectors`` (id, unit embedding, flat
metadata; by cell and with codes where asked for, see ``operators.cells``), ``chunks`` and ``postings`` (see ``operators.blocks``) and ``terms``
(document frequencies).  Every write goes to its own ``batch=<label>`` folder,
so appends never rewrite what is there and a repeated write of a batch replaces
exactly itself.

A row in ``batches``, written last and in one file, makes a batch visible.  It
carries the corpus totals as of that batch, so opening an index aggregates no
vocabulary, and the labels that the batch replaces: small batches are merged into
larger ones (:meth:`IndexStore.compact`), and the one row of the merged batch
takes the place of all rows it names.  A reader takes the folders of the batches
that were visible when it was opened; merges leave those alone until
:meth:`IndexStore.vacuum` is called.

Below a batch, documents are split into folders by a hash of the id and
postings by a hash of the term.  Fetching the texts of some hits, or the
postings of some terms, then reads the folders of those keys and no others.
The number of folders is a power of two that follows from the measured size of
the batch; adaptive execution splits what is too much for a file.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from math import ceil, floor, log, log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..config import SizeLimits
from ..operators.blocks import CHUNK_DOCS, merge_chunks, packed_postings, packed_terms
from ..operators.cells import PACKED, CellCodes, calibrated, coded, train
from ..operators.embed import Encoder, embed
from ..operators.lexical import Corpus, corpus_statistics
from ..operators.sizing import broadcast_if_small, measure, shard_of
from ..session import materialise, spread

TABLES = ("terms", "postings", "chunks", "cells", "vectors", "documents")
SHARD_BYTES = 256 << 20
#: As many batches of similar size (within a factor of MERGE_AT) become one.
MERGE_AT = 4
_LABEL = r"[A-Za-z][\w.-]*"
_CORPUS = {"n_docs": "bigint", "total_length": "bigint", "n_terms": "bigint", "avgdl": "double", "avg_idf": "double"}
_BATCH = "label string, seq bigint, shards int, documents bigint, probes int, rescore int, replaces array<string>, corpus struct<" + ", ".join(f"{c}: {t}" for c, t in _CORPUS.items()) + ">"


@dataclass(frozen=True)
class Snapshot:
    """The batches that were visible at one moment, with their totals."""

    spark: SparkSession
    path: str
    labels: tuple[str, ...]
    shards: tuple[int, ...]
    documents_count: int
    corpus: Corpus
    #: Batches whose vectors have cells and codes, with the cells to probe and the vectors to score exactly.
    coded: tuple[tuple[str, int, int], ...] = ()

    def read(self, name: str) -> DataFrame:
        """One table over the batches of this moment; ``select`` what is needed and only that is read."""
        base = f"{self.path.rstrip('/')}/{name}"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/batch={label}" for label in self.labels])

    def documents(self) -> DataFrame:
        return self.read("documents").drop("batch")

    def vectors(self) -> DataFrame:
        return self.read("vectors").drop("batch", "cell", "code")

    def coded_vectors(self) -> list[tuple[DataFrame, CellCodes, int, int]]:
        """Vectors by cell, their cells and codes, probes and rescoring: for each batch that has them."""
        found = []
        for label, probes, rescore in self.coded:
            row = self.spark.read.parquet(f"{self.path.rstrip('/')}/cells/batch={label}").first()
            rows = self.read("vectors").filter(F.col("batch") == label).drop("batch").withColumn("cell", F.col("cell").cast("int"))
            found.append((rows, CellCodes.unpacked(row.asDict()), probes, rescore))
        return found

    def plain_vectors(self) -> DataFrame | None:
        """Vectors of the batches without codes."""
        plain = [label for label in self.labels if label not in {c[0] for c in self.coded}]
        return self.read("vectors").filter(F.col("batch").isin(plain)).drop("batch", "cell", "code") if plain else None

    def chunks(self) -> DataFrame:
        return self.read("chunks")

    def posting_rows(self) -> DataFrame:
        return self.read("postings")

    def terms(self) -> DataFrame:
        """``term, df``; a single batch needs no aggregation.  Totals are in ``corpus``."""
        rows = self.read("terms").filter(F.col("term").isNotNull()).select("term", "df")
        return rows if len(self.labels) == 1 else rows.groupBy("term").agg(F.sum("df").alias("df"))


@dataclass(frozen=True)
class IndexStore:
    """Location of an index; all methods work on whole tables."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(name)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        """Whether a batch has been written completely."""
        where, files = self._folder(self._table("batches"))
        return files.exists(where)

    def history(self) -> DataFrame:
        """A row per complete batch, also of those that another one has replaced."""
        if not self.exists():
            return self.spark.createDataFrame([], _BATCH)
        return self.spark.read.schema(_BATCH).parquet(self._table("batches"))

    def batches(self) -> DataFrame:
        """The visible batches."""
        rows = self.history()
        gone = rows.select(F.explode("replaces").alias("label"))
        return rows.join(gone, "label", "left_anti")

    def snapshot(self) -> Snapshot:
        """What a reader sees from now on: a few numbers per batch, kept few by merging."""
        rows = sorted(self.batches().collect(), key=lambda r: r["seq"])
        if not rows:
            raise ValueError(f"no index at {self.path}")
        return Snapshot(
            self.spark, self.path, tuple(r["label"] for r in rows), tuple(sorted({r["shards"] for r in rows})),
            sum(r["documents"] for r in rows), Corpus(**rows[-1]["corpus"].asDict()),
            tuple((r["label"], r["probes"], r["rescore"]) for r in rows if r["probes"]))

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def documents(self) -> DataFrame:
        return self.snapshot().documents()

    def vectors(self) -> DataFrame:
        return self.snapshot().vectors()

    def postings(self) -> DataFrame:
        """``term, doc_id, tf, doc_len``, unpacked: for inspection, not for searching."""
        now = self.snapshot()
        places = F.transform(F.sequence(F.lit(1), F.col("n")), lambda n: _number("places", n, 2))
        tfs = F.transform(F.sequence(F.lit(1), F.col("n")), lambda n: _number("tfs", n, 4))
        rows = now.posting_rows().select("batch", "chunk", "term", F.explode(F.arrays_zip(places.alias("place"), tfs.alias("tf"))).alias("p"))
        heads = now.chunks().select(F.col("batch"), F.col("chunk"), "ids", F.col("lengths"))
        at = F.col("p.place") + 1
        return rows.join(heads, ["batch", "chunk"]).select(
            "term", F.element_at("ids", at.cast("int")).alias("doc_id"), F.col("p.tf").alias("tf"), _number("lengths", at, 4).alias("doc_len"))

    def terms(self) -> DataFrame:
        """Corpus-wide document frequencies."""
        return self.snapshot().terms()

    def count(self) -> int:
        return self.snapshot().documents_count if self.exists() else 0

    def shards(self) -> list[int]:
        """The numbers of folders that occur, a few powers of two."""
        return list(self.snapshot().shards)

    def only_new(self, docs: DataFrame, batch: str, limits: SizeLimits = SizeLimits()) -> DataFrame:
        """Documents whose id is in no other batch.

        The stored ids are filtered by the incoming ones first (a broadcast
        when those are few), so the stored side is scanned but not shuffled.
        """
        if not self.exists() or self.snapshot().labels == (batch,):
            return docs
        incoming = broadcast_if_small(docs.select("doc_id"), limits.broadcast_bytes)
        seen = (
            self.read("documents").filter(F.col("batch") != batch).select("doc_id")
            .join(incoming, "doc_id", "left_semi")
        )
        return materialise(docs.join(seen, "doc_id", "left_anti"), "new-documents")

    def append(
        self, docs: DataFrame, batch: str, encoder: Encoder | None = None, limits: SizeLimits = SizeLimits(), cells: bool = False,
    ) -> None:
        """Add the documents that are not there yet, under a batch label; with ``cells`` their vectors get cells and codes.

        Safe to repeat with the same label, also after a failure half way, and
        after the batch was merged into another one.  Nothing new writes nothing.
        An id that occurs twice in ``docs`` is an error.
        """
        if not re.fullmatch(_LABEL, batch):
            raise ValueError(f"a batch label starts with a letter and has no blanks or slashes: {batch!r}")
        if self.history().filter(F.array_contains("replaces", batch)).count():
            return
        docs = self.only_new(docs, batch, limits)
        size = measure(docs)
        if not size.rows:
            return
        shards = 1 << max(0, ceil(log2(max(size.bytes, 1) / SHARD_BYTES)))
        self._write(self._sharded(docs, "doc_id", shards), "documents", batch, "shards", "shard")
        # What follows reads the stored texts, so the source is not computed again.
        stored = self.spark.read.parquet(f"{self._table('documents')}/batch={batch}").drop("shards", "shard")
        twice = stored.groupBy("doc_id").count().filter("count > 1").first()
        if twice:
            raise ValueError(f"document id occurs more than once: {twice['doc_id']}")
        stored = spread(stored)
        meta = [c for c in docs.columns if c.startswith("meta_")]
        packed = materialise(packed_postings(stored.select("doc_id", "text", *meta)), "packed")
        self._index(packed, batch, shards)
        vectors = embed(stored.select("doc_id", "text", *meta), encoder).drop("text")
        self._show(batch, shards, size.rows, [], self._vectors(vectors, batch, size.rows, cells))

    def _sharded(self, rows: DataFrame, key: str, shards: int) -> DataFrame:
        """Rows with their folder, dealt out for writing: folders that are too large for a task are split at run time."""
        return rows.withColumn("shards", F.lit(shards).cast("int")).withColumn("shard", shard_of(key, shards)).hint("rebalance", "shards", "shard")

    def _vectors(self, vectors: DataFrame, batch: str, n: int, cells: bool) -> tuple[int, int]:
        """Write the vectors in a folder per cell; probes and rescoring, 0 without cells."""
        if not cells:
            self._write(vectors.withColumn("cell", F.lit(0)).withColumn("code", F.lit(None).cast("binary")), "vectors", batch, "cell")
            return 0, 0
        vectors = materialise(vectors, "embedded")
        codes = train(vectors, n, width=max(4, -(-len(vectors.first()["embedding"]) // 48)))
        self._write(coded(vectors, codes).hint("rebalance", "cell"), "vectors", batch, "cell")
        self._write(self.spark.createDataFrame([codes.packed()], PACKED).coalesce(1), "cells", batch)
        rows = self.spark.read.parquet(f"{self._table('vectors')}/batch={batch}").withColumn("cell", F.col("cell").cast("int"))
        return calibrated(rows, codes)

    def _index(self, packed: DataFrame, batch: str, shards: int) -> None:
        """Chunks, postings and document frequencies of a batch."""
        heads = packed.filter(F.col("term").isNull())
        metas = [c for c in packed.columns if c.startswith("meta_")]
        posting = packed.filter(F.col("term").isNotNull()).select("chunk", "term", "n", "places", "tfs", "peak_blocks", "peak_tfs", "peak_lengths")
        self._write(self._sharded(posting, "term", shards).sortWithinPartitions("shards", "shard", "term"), "postings", batch, "shards", "shard")
        self._write(heads.select("chunk", "n", "length", "lengths", "ids", *metas), "chunks", batch)
        self._write(packed_terms(packed), "terms", batch)

    def _show(self, batch: str, shards: int, documents: int, replaces: list[str], coding: tuple[int, int]) -> None:
        """Compute the totals with this batch and write its row, which makes it visible."""
        rows = self.history().filter(F.col("label") != batch)
        known = {r["label"]: (r["seq"], r["replaces"]) for r in rows.collect()}
        gone = {x for _, old in known.values() for x in old} | set(replaces)
        labels = [*(x for x in known if x not in gone), batch]
        parts = self.spark.read.option("basePath", self._table("terms")).parquet(*[f"{self._table('terms')}/batch={x}" for x in labels])
        summed = parts if len(labels) == 1 else parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "length")])
        corpus = corpus_statistics(summed if len(labels) == 1 else materialise(summed, "vocabulary"))
        row = corpus.select(
            F.lit(batch).alias("label"), F.lit(1 + max((s for s, _ in known.values()), default=0)).cast("bigint").alias("seq"), F.lit(shards).cast("int").alias("shards"),
            F.lit(documents).cast("bigint").alias("documents"),
            F.lit(coding[0]).alias("probes"), F.lit(coding[1]).alias("rescore"), F.array(*map(F.lit, replaces)).cast("array<string>").alias("replaces"),
            F.struct(*[F.col(c).cast(t).alias(c) for c, t in _CORPUS.items()]).alias("corpus"))
        self._write(row.coalesce(1), "batches", batch)

    def _write(self, df: DataFrame, name: str, batch: str, *folders: str) -> None:
        df.write.mode("overwrite").partitionBy(*folders).parquet(f"{self._table(name)}/batch={batch}")

    # -- merging ------------------------------------------------------------

    def due(self) -> list[str]:
        """Labels of the smallest tier that has ``MERGE_AT`` batches, or none."""
        tiers: dict[int, list[str]] = {}
        for row in sorted(self.batches().select("label", "documents", "seq").collect(), key=lambda r: r["seq"]):
            tiers.setdefault(floor(log(max(row["documents"], 1), MERGE_AT)), []).append(row["label"])
        full = [labels for _, labels in sorted(tiers.items()) if len(labels) >= MERGE_AT]
        return full[0] if full else []

    def compact(self) -> list[str]:
        """Merge tiers until none is due; the labels of the new batches."""
        done = []
        while labels := self.due():
            done.append(self.merge(labels))
        return done

    def merge(self, labels: list[str]) -> str:
        """Make one batch of several, without reading a text twice or asking the encoder again.

        Postings are renumbered into chunks of full size and sorted by term.
        The new label follows from the old ones, so a merge that was cut short
        is repeated into the same folders.
        """
        into = "merged-" + hashlib.md5("\n".join(sorted(labels)).encode()).hexdigest()[:16]
        part = Snapshot(self.spark, self.path, tuple(labels), (), 0, Corpus(0, 0, 0, 0.0, 0.0))
        docs = part.read("documents").drop("batch", "shards", "shard")
        size = measure(docs)
        shards = 1 << max(0, ceil(log2(max(size.bytes, 1) / SHARD_BYTES)))
        self._write(self._sharded(docs, "doc_id", shards), "documents", into, "shards", "shard")
        cells = self.batches().filter(F.col("label").isin(labels) & (F.col("probes") > 0)).count() > 0
        coding = self._vectors(part.vectors(), into, size.rows, cells)
        self._index(materialise(self._merged_chunks(part), "merged"), into, shards)
        self._show(into, shards, size.rows, labels, coding)
        return into

    def _merged_chunks(self, part: Snapshot) -> DataFrame:
        """Packed postings of all batches, in chunks of up to ``CHUNK_DOCS`` documents."""
        heads = part.chunks()
        metas = [c for c in heads.columns if c.startswith("meta_")]
        order = Window.orderBy("batch", "chunk")
        # One row per chunk, without ids and lengths: tens of bytes for thousands of documents.
        runs = heads.select("batch", "chunk", "n").withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        turns = materialise(runs.select(
            "batch", "chunk", F.floor(F.coalesce("before", F.lit(0)) / (CHUNK_DOCS // 2)).alias("new"), F.row_number().over(order).alias("turn")), "turns")
        rows = part.posting_rows().drop("shards", "shard")
        types = {f.name: f.dataType for f in [*rows.schema, *heads.schema]}
        schema = T.StructType([T.StructField(c, types[c]) for c in (
            "chunk", "term", "n", "length", "places", "tfs", "peak_blocks", "peak_tfs", "peak_lengths", "lengths", "ids", *metas)])

        def run(key: tuple, rows: pa.Table, heads: pa.Table) -> pa.Table:
            return merge_chunks(rows, heads, key[0].as_py(), metas)

        # Two sides: in one table the lists of chunks would be null in all posting rows, and on the way to
        # Python a null list takes a time that grows with the rows before it.
        turns = broadcast_if_small(turns, SizeLimits().broadcast_bytes)
        # Both come from one table of turns: aliases keep their columns apart.
        left, right = (x.join(turns, ["batch", "chunk"]).select(*[F.col(c).alias(c) for c in ("new", "turn", "n", *own)]).groupBy("new") for x, own in (
            (rows, ("term", "places", "tfs")), (heads, ("lengths", "ids", *metas))))
        return left.cogroup(right).applyInArrow(run, schema)

    def vacuum(self) -> list[str]:
        """Delete the folders of batches that others have replaced; readers opened before that lose them."""
        gone = [r["label"] for r in self.history().join(self.batches(), "label", "left_anti").select("label").collect()]
        for label in gone:
            for name in TABLES:
                where, files = self._folder(f"{self._table(name)}/batch={label}")
                files.delete(where, True)
        return gone

    def reset(self, docs: DataFrame, batch: str = "initial", encoder: Encoder | None = None, cells: bool = False) -> None:
        """Replace the whole index."""
        self.clear()
        self.append(docs, batch, encoder, cells=cells)

    def clear(self) -> None:
        """Remove all tables of the index."""
        for name in ("batches", *reversed(TABLES)):
            where, files = self._folder(self._table(name))
            files.delete(where, True)


def _number(column: str, n, width: int):
    """The ``n``-th (from 1) little-endian number in a binary column."""
    begin = (n.cast("int") - 1) * width + 1
    parts = [F.conv(F.hex(F.substring(F.col(column), begin + b, F.lit(1))), 16, 10).cast("long") * (1 << (8 * b)) for b in range(width)]
    return sum(parts[1:], parts[0])
