"""Cosine search over cells of vectors with product-quantised codes.

A vector lies in the cell of its nearest centroid, and its residual is a short
code: one entry number for each group of ``width`` dimensions.  A search ranks
the cells of each query, reads the codes of the first ``probes`` cells only, and
adds up one looked-up product per group.  The ``rescore`` best by code are scored
exactly; nothing else of the vectors is read.

Stored vectors have a folder per cell, so the folders that no query probes are
pruned when a search runs, and codes are a column of their own.  About the
square root of the measured count are cells.  Centroids and code entries are
trained in one task on a bounded sample (``SAMPLE`` vectors), or picked by a
written-down rule; every vector is assigned and coded where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..config import RetrievalConfig, SizeLimits
from ..session import materialise
from .nearest import (
    Q_STRIPES, V_STRIPES, Products, _Best, _arrow_id, _hit_schema, _ids, _matrix, best_first, nearest, product_error, products, recall_at_k, stripe_count,
)
from .sizing import broadcast_if_small, measure

#: Vectors that centroids and entries are trained on at most, cells at most, entries of a group.
SAMPLE, MOST_CELLS, ENTRIES = 65_536, 4096, 256
ROUNDS = 8
#: Probing and rescoring are tried on so many stored vectors.
TRIALS = 200
_DIGITS = 9
_PIECE = 2_000_000      # numbers held at once while coding or scoring
_PAIR = 64              # bytes of a pair while it is ranked: beyond the broadcast limit pairs stay in their tasks
_BINS, _REACH = 256, 1.25       # scores by code are counted in bins from -_REACH to _REACH


@dataclass(frozen=True)
class CellCodes:
    """Centroids (cells x dim) and entries (groups x entries x width) of residuals."""

    centroids: np.ndarray
    entries: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def _groups(self, x: np.ndarray) -> np.ndarray:
        groups, _, width = self.entries.shape
        return np.pad(x, ((0, 0), (0, groups * width - x.shape[1]))).reshape(len(x), groups, width)

    def _closeness(self, x: np.ndarray) -> np.ndarray:
        return np.round(x @ self.centroids.T - (self.centroids**2).sum(1) / 2, _DIGITS)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector; ties go to the smaller number."""
        return self._closeness(x).argmax(1)

    def probe(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each vector."""
        return np.argsort(-self._closeness(x), axis=1, kind="stable")[:, :probes]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Entry numbers of the residuals; ties go to the smaller number."""
        rest = self._groups(x - self.centroids[cell])
        out = np.empty(rest.shape[:2], np.uint8)
        norms = (self.entries**2).sum(2)
        step = max(1, _PIECE // self.entries.shape[1])
        for g, entries in enumerate(self.entries):
            for at in range(0, len(x), step):
                part = rest[at:at + step, g]
                out[at:at + step, g] = np.round(norms[g] - 2 * part @ entries.T + (part**2).sum(1, keepdims=True), _DIGITS).argmin(1)
        return out

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        whole = self.entries[np.arange(len(self.entries)), code].reshape(len(code), -1)
        return self.centroids[cell] + whole[:, :self.centroids.shape[1]]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with all entries: queries x groups x entries."""
        return np.einsum("qgw,gew->qge", self._groups(q), self.entries)

    def packed(self) -> dict[str, object]:
        return {
            "cells": self.cells, "dim": self.centroids.shape[1], "groups": self.entries.shape[0], "size": self.entries.shape[1], "width": self.entries.shape[2],
            "centroids": self.centroids.astype("<f8").tobytes(), "entries": self.entries.astype("<f8").tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict) -> CellCodes:
        return cls(
            np.frombuffer(row["centroids"], "<f8").reshape(row["cells"], row["dim"]),
            np.frombuffer(row["entries"], "<f8").reshape(row["groups"], row["size"], row["width"]))


PACKED = "cells int, dim int, groups int, size int, width int, centroids binary, entries binary"


def cell_count(n: int) -> int:
    return max(1, min(MOST_CELLS, round(sqrt(n))))


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of ``k`` clusters; an empty cluster starts again at the vector that is farthest from its own centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        apart = (centres**2).sum(1) - 2 * x @ centres.T
        near = apart.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(-(apart[np.arange(len(x)), near] + (x**2).sum(1)), kind="stable")[:len(empty)]
            centres[empty[:len(far)]] = x[far]
    return centres


def fit(x: np.ndarray, cells: int, width: int, seed: int = 7) -> CellCodes:
    """Centroids, then entries for every group of dimensions from the residuals."""
    centroids = _means(x, min(cells, len(x)), seed)
    plain = CellCodes(centroids, np.zeros((ceil(x.shape[1] / width), 1, width)))
    rest = plain._groups(x - centroids[plain.assign(x)])
    size = min(ENTRIES, max(1, len(x)))
    return CellCodes(centroids, np.stack([_means(rest[:, g], size, seed + g + 1) for g in range(rest.shape[1])]))


def train(vectors: DataFrame, n: int, width: int = 4, seed: int = 7) -> CellCodes:
    """Cells and codes for ``n`` vectors, learned in one task from at most ``SAMPLE`` of them, picked by a hash of the id."""
    cells = cell_count(n)
    chosen = vectors.select("doc_id", "embedding").filter(F.size("embedding") > 0)
    if n > SAMPLE:
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n) + 1)
    limit = 2 * SAMPLE

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.sort_by("doc_id")["embedding"])[:limit]
        return pa.table({k: [v] for k, v in fit(x, cells, width, seed).packed().items()}).cast(arrow)

    arrow = pa.schema([*((c, pa.int32()) for c in ("cells", "dim", "groups", "size", "width")), ("centroids", pa.binary()), ("entries", pa.binary())])
    rows = chosen.groupBy(F.lit(0).alias("one")).applyInArrow(run, PACKED).collect()
    if not rows:
        raise ValueError("no vectors to train on")
    return CellCodes.unpacked(rows[0].asDict())


def picked(vectors: DataFrame, n: int, width: int = 4, size: int = ENTRIES) -> CellCodes:
    """Cells and codes without training: the vectors, and the residuals of the vectors, whose ids come first by MD5.

    Coordinates are rounded to six decimals.  Any engine can repeat this rule.
    """
    def first(mark: str, k: int) -> np.ndarray:
        order = F.md5(F.concat(F.lit(mark), F.col("doc_id").cast("string")))
        table = vectors.filter(F.size("embedding") > 0).select("doc_id", "embedding", order.alias("o")).orderBy("o", "doc_id").limit(k).toArrow()
        return _matrix(table["embedding"])

    centroids = np.round(first("cell:", cell_count(n)), 6)
    plain = CellCodes(centroids, np.zeros((ceil(centroids.shape[1] / width), 1, width)))
    x = first("code:", min(size, n))
    rest = plain._groups(np.round(x - centroids[plain.assign(x)], 6))
    return CellCodes(centroids, np.ascontiguousarray(rest.transpose(1, 0, 2)))


def coded(vectors: DataFrame, codes: CellCodes) -> DataFrame:
    """Add ``cell`` and ``code`` to every vector, where it lies; vectors without components go."""
    shared = vectors.sparkSession.sparkContext.broadcast(codes.packed())
    at = vectors.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = CellCodes.unpacked(shared.value)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(at))
                cell = codes.assign(x)
                raw = codes.encode(x, cell)
                offsets = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
                code = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), code], names=[*batch.schema.names, "cell", "code"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])
    return vectors.filter(F.size("embedding") > 0).mapInArrow(run, schema)


def write_coded(rows: DataFrame, path: str, codes: CellCodes) -> None:
    """Store coded vectors in a folder per cell, and the cells beside them.  Folders of large cells get several files."""
    spark = rows.sparkSession
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([codes.packed()], PACKED).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def read_coded(spark: SparkSession, path: str) -> tuple[DataFrame, CellCodes]:
    codes = CellCodes.unpacked(spark.read.parquet(f"{path}/cells").first().asDict())
    return spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("int")), codes


def _foremost(held: list[tuple], n: int) -> tuple:
    """Of (query, id, cell, score) the ``n`` best of each query, ties to the smaller id."""
    query, cell, near = (np.concatenate([x[c] for x in held]) for c in (0, 2, 3))
    doc = pa.concat_arrays([x[1] for x in held])
    order = np.lexsort((_ids(doc), -near, query))
    kept = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < n]
    return query[kept], doc.take(pa.array(kept)), cell[kept], near[kept]


def _survivors(rows: DataFrame, asked: DataFrame, codes: CellCodes, probes: int, rescore: int) -> DataFrame:
    """(query_id, doc_id, cell) of the ``rescore`` best by code in the probed cells."""
    spark = rows.sparkSession
    table = asked.toArrow()
    matrix = _matrix(table["embedding"])
    shared = spark.sparkContext.broadcast((codes.packed(), matrix, codes.probe(matrix, probes) if len(matrix) else np.zeros((0, 1), np.int64)))
    ids = table["query_id"].combine_chunks() if len(matrix) else pa.array([], pa.int64())
    numbered = {"number": T.LongType(), "doc_id": rows.schema["doc_id"].dataType, "cell": T.IntegerType(), "near": T.DoubleType()}
    schema = T.StructType([T.StructField(c, t) for c, t in numbered.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, matrix, probed = shared.value
        codes = CellCodes.unpacked(packed)
        groups = np.arange(codes.entries.shape[0])
        base = matrix @ codes.centroids.T
        flat = codes.tables(matrix).reshape(len(matrix), -1)
        held, pairs, size = [], 0, codes.entries.shape[1]
        most = max(_PIECE // 2, 2 * len(matrix) * rescore)
        for batch in batches:
            cells = batch.column(1).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for cell in np.unique(cells):
                rows = np.flatnonzero(cells == cell)
                asking = np.flatnonzero((probed == cell).any(1))
                place = code[rows].astype(np.int64) + groups * size
                doc = batch.column(0).take(pa.array(rows))
                step = max(1, _PIECE // max(1, place.size))
                for at in range(0, len(asking), step):
                    q = asking[at:at + step]
                    near = np.round(base[q, cell][:, None] + flat[q][:, place].sum(2), _DIGITS)
                    if near.shape[1] > rescore:
                        # Ties at the border all stay; the ranking decides.
                        least = np.partition(near, near.shape[1] - rescore, axis=1)[:, -rescore, None]
                        row, col = np.nonzero(near >= least)
                    else:
                        row, col = (x.ravel() for x in np.indices(near.shape))
                    held.append((q[row], doc.take(pa.array(col)), np.full(len(row), cell, np.int32), near[row, col]))
                    pairs += len(row)
                    if pairs > most:
                        held = [_foremost(held, rescore)]
                        pairs = len(held[0][0])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in _foremost(held, rescore)], names=list(numbered))

    wanted = np.unique(shared.value[2]).tolist()
    # Partition values as a literal list: the folders of other cells are not even listed.
    found = rows.select("doc_id", "cell", "code").filter(F.col("cell").isin(wanted)).mapInArrow(run, schema)
    order = Window.partitionBy("number").orderBy(F.desc("near"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rescore).select("number", "doc_id", "cell")
    names = spark.createDataFrame(pa.table({"number": pa.array(np.arange(len(ids))), "query_id": ids}))
    return best.join(F.broadcast(names), "number").drop("number")


class _Looked:
    """Queries and coded vectors of a pair of stripes: scores by code of the probed vectors, a slab at a time."""

    def __init__(self, docs: pa.Table, qs: pa.Table, codes: CellCodes, probes: int):
        # The same order in every round, so that a slab has the same scores.
        self.docs, self.qs = docs.sort_by([("cell", "ascending"), ("doc_id", "ascending")]), qs.sort_by("number")
        self.cell = self.docs["cell"].to_numpy()
        raw = np.frombuffer(b"".join(self.docs["code"].to_pylist()), np.uint8).reshape(len(self.cell), -1)
        self.vectors, self.doc = codes.decode(self.cell, raw), _ids(self.docs["doc_id"].combine_chunks())
        self.asked, self.codes, self.probes = _matrix(self.qs["embedding"]), codes, probes

    def slabs(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Queries, vectors and their scores; -inf where the cell is not probed."""
        for begin in range(0, len(self.asked), 512):
            of = slice(begin, min(begin + 512, len(self.asked)))
            probed = np.zeros((of.stop - begin, self.codes.cells), bool)
            np.put_along_axis(probed, self.codes.probe(self.asked[of], self.probes), True, axis=1)
            step = max(1, _PIECE // 2 // len(probed))
            for start in range(0, len(self.vectors), step):
                at = slice(start, min(start + step, len(self.vectors)))
                near = np.round(self.asked[of] @ self.vectors[at].T, _DIGITS)
                near[~probed[:, self.cell[at]]] = -np.inf
                yield of, at, near


def _bins(near: np.ndarray) -> np.ndarray:
    """The bin of each score, 0 for none; the outermost bins have no end."""
    return 1 + np.clip((near + _REACH) * (_BINS / (2 * _REACH)), -1, _BINS - 1).astype(np.int16)


def _few(query: np.ndarray, near: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of equal scores by code only the k that come first by score and id can be hits."""
    order = np.lexsort((doc, -score, near, query))
    query, near = query[order], near[order]
    begins = np.flatnonzero(np.concatenate(([True], (query[1:] != query[:-1]) | (near[1:] != near[:-1]))))
    sizes = np.diff(np.concatenate((begins, [len(query)])))
    return order[np.arange(len(query)) - np.repeat(begins, sizes) < k]


@dataclass(frozen=True)
class _Stripes:
    """Stripes of queries meet stripes of coded vectors, a task per pair."""

    rows: DataFrame
    vectors: int
    queries: int

    @classmethod
    def of(cls, rows: DataFrame, n_rows: int, n_asked: int, limits: SizeLimits) -> _Stripes:
        return cls(rows, stripe_count(n_rows, limits.block_rows, V_STRIPES), stripe_count(n_asked, limits.block_rows, Q_STRIPES))

    def numbered(self, asked: DataFrame) -> DataFrame:
        """Queries with a number of their own and their stripe.  To be stored: numbers depend on the partitions."""
        return asked.withColumn("number", F.monotonically_increasing_id()).withColumn(
            "query_stripe", F.pmod(F.xxhash64("number"), F.lit(self.queries)).cast("int"))

    def met(self, columns: list[str], queries: DataFrame, run, schema: str) -> DataFrame:
        keys = ("vector_stripe", "query_stripe")
        parts = max(V_STRIPES * (self.vectors + self.queries), int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = self.rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(self.vectors)).cast("int").alias(keys[0]), every(self.queries).alias(keys[1]), "doc_id", "cell", *columns)
        right = queries.withColumn(keys[0], every(self.vectors))
        left, right = (x.repartition(parts, *keys).groupBy(*keys) for x in (left, right))
        return left.cogroup(right).applyInArrow(run, schema)


class _Ranks:
    """For each query and each of its tried vectors, how many of the vectors shown have a better code.

    ``near`` and ``doc`` of what is tried: queries x tries, NaN where there is none.
    """

    def __init__(self, asked: np.ndarray, near: np.ndarray, doc: np.ndarray):
        self.asked, self.near, self.doc = asked, near, doc
        self.order = np.argsort(near, axis=1, kind="stable")        # NaN comes last
        self.steps = np.nan_to_num(np.take_along_axis(near, self.order, 1), nan=9.0)
        self.better = np.zeros(near.shape, np.int64)                # in ascending order of what is tried

    def add(self, vectors: np.ndarray, doc: np.ndarray, cell: np.ndarray, probed: np.ndarray | _Probed) -> None:
        if not len(vectors):
            return
        near_q, near_v = self.asked.astype(np.float32), vectors.astype(np.float32)
        off = product_error(vectors.shape[1]) * max(1.0, float(np.sqrt((vectors**2).sum(1).max()))) + 10.0**-_DIGITS
        m = self.steps.shape[1]
        for begin in range(0, len(self.asked), 256):
            of = slice(begin, begin + 256)
            looked = probed[of]
            # Steps of all queries in one ascending line, twenty apart.
            steps = (self.steps[of] + 20.0 * np.arange(len(self.steps[of]))[:, None]).ravel()
            least = self.steps[of, 0] - 2 * off
            scores = Products(near_q[of], _PIECE // 2)
            for start in range(0, len(vectors), scores.step):
                at = slice(start, start + scores.step)
                near = scores.of(near_v[at])
                row, col = scores.reach(near, least)
                inside = looked[row, cell[at][col]]
                row, col = row[inside], col[inside]
                value = near[row, col].astype(np.float64) + 20.0 * row
                below = np.searchsorted(steps, value - off) - row * m       # steps that it is above for sure
                open_ = np.searchsorted(steps, value + off, side="right") - row * m - below
                held = np.bincount(row * (m + 1) + below, minlength=len(self.steps[of]) * (m + 1)).reshape(-1, m + 1)
                self.better[of] += held[:, :0:-1].cumsum(1)[:, ::-1]
                near_some = np.flatnonzero(open_)
                for n in range(0, len(near_some), 1 << 15):
                    some = near_some[n:n + (1 << 15)]
                    exact = np.round(products(self.asked[of], vectors[at], row[some], col[some]), _DIGITS)
                    times = open_[some]
                    which = np.repeat(np.arange(len(some)), times)
                    step = below[some][which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    query = begin + row[some][which]
                    tried = self.order[query, step]
                    value, own = self.near[query, tried], self.doc[query, tried]
                    won = (exact[which] > value) | ((exact[which] == value) & (doc[at][col[some]][which] < own))
                    np.add.at(self.better, (query[won], step[won]), 1)

    def counts(self) -> np.ndarray:
        out = np.empty_like(self.better)
        np.put_along_axis(out, self.order, self.better, 1)
        return out


class _Probed:
    """Which cells each query looks at, unpacked for the queries that are asked for."""

    def __init__(self, column: pa.ChunkedArray, cells: int):
        self.packed, self.cells = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), cells

    def __getitem__(self, at: slice) -> np.ndarray:
        return np.unpackbits(self.packed[at], axis=1, count=self.cells).astype(bool)


def _striped(
    rows: DataFrame, asked: DataFrame, codes: CellCodes, k: int, probes: int, rescore: int, decimals: int, limits: SizeLimits, n_asked: int,
) -> DataFrame:
    """The same hits, and ``scored``, without a row for each pair of a query and a vector that it scores.

    What comes first by exact score in the probed cells comes first of all that
    is scored, if it is scored.  The first round finds the ``2 * k`` best of each
    query by exact score; the second counts the vectors with a better code than
    each of them, which tells whether it is scored.  Queries with fewer than
    ``k`` scored ones among them are answered by :func:`_binned`.
    """
    spark = rows.sparkSession
    per_cell = np.zeros(codes.cells, np.int64)
    # A row per cell.
    for row in rows.groupBy("cell").count().collect():
        per_cell[row["cell"]] = row["count"]
    n, tries = int(per_cell.sum()), 2 * k
    shared = spark.sparkContext.broadcast((codes.packed(), per_cell))
    stripes = _Stripes.of(rows, n, n_asked, limits)
    doc_type, query_type = rows.schema["doc_id"].dataType, asked.schema["query_id"].dataType
    docs_arrow = _arrow_id(doc_type)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, per_cell = shared.value
        codes = CellCodes.unpacked(packed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                probed = np.zeros((piece.num_rows, codes.cells), bool)
                np.put_along_axis(probed, codes.probe(_matrix(piece.column(1)), probes), True, axis=1)
                cells = pa.array([x.tobytes() for x in np.packbits(probed, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*piece.columns, cells, pa.array(np.minimum(probed @ per_cell, rescore))], names=[*piece.schema.names, "probed", "scored"])

    numbered = stripes.numbered(asked)
    numbered = materialise(numbered.mapInArrow(probing, T.StructType([
        *numbered.schema.fields, T.StructField("probed", T.BinaryType()), T.StructField("scored", T.LongType())])), "numbered")
    first_arrow = pa.schema([("number", pa.int64()), ("query_id", _arrow_id(query_type)), ("doc_id", docs_arrow), ("near", pa.float64()), ("score", pa.float64())])

    def first(docs: pa.Table, qs: pa.Table) -> pa.Table:
        if not docs.num_rows or not qs.num_rows:
            return first_arrow.empty_table()
        # In the order of ids, places break ties as ids do.
        docs, codes = docs.sort_by("doc_id"), CellCodes.unpacked(shared.value[0])
        vectors, queries, cell = _matrix(docs["embedding"]), _matrix(qs["embedding"]), docs["cell"].to_numpy()
        best = _Best(len(queries), tries, decimals)
        best.add(queries, np.arange(len(queries)), np.arange(len(vectors)), vectors, _Probed(qs["probed"], codes.cells), cell)
        found = best.frame(np.arange(len(queries)))
        query, place = found["query_id"], found["doc_id"].astype(np.int64)
        take, raw = pa.array(place), docs["code"].take(pa.array(place)).to_pylist()
        near = np.empty(len(place))
        for n in range(0, len(place), 1 << 15):
            at = slice(n, n + (1 << 15))
            code = np.frombuffer(b"".join(raw[at]), np.uint8).reshape(len(place[at]), -1)
            near[at] = np.round(np.einsum("ij,ij->i", queries[query[at]], codes.decode(cell[place[at]], code)), _DIGITS)
        return pa.table([
            qs["number"].take(pa.array(query)), qs["query_id"].take(pa.array(query)), docs["doc_id"].take(take).cast(docs_arrow), pa.array(near), pa.array(found["score"]),
        ], schema=first_arrow)

    schema = f"number long, query_id {query_type.simpleString()}, doc_id {doc_type.simpleString()}, near double, score double"
    found = stripes.met(["code", "embedding"], numbered.select("number", "query_id", "embedding", "probed", "query_stripe"), first, schema)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    found = materialise(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= tries), "first")
    better_arrow = pa.schema([("query_stripe", pa.int32()), ("number", pa.int64()), ("better", pa.binary())])

    def rank(docs: pa.Table, qs: pa.Table) -> pa.Table:
        if not docs.num_rows or not qs.num_rows:
            return better_arrow.empty_table()
        codes, cell = CellCodes.unpacked(shared.value[0]), docs["cell"].to_numpy()
        code = np.frombuffer(b"".join(docs["code"].to_pylist()), np.uint8).reshape(len(cell), -1)
        tried = qs["tried"].combine_chunks()
        sizes, flat = tried.value_lengths().to_numpy(), tried.flatten()
        query = np.repeat(np.arange(len(sizes)), sizes)
        place = flat.field("place").to_numpy() - 1
        own = _ids(flat.field("doc_id"))
        near, doc = np.full((len(sizes), tries), np.nan), np.zeros((len(sizes), tries), own.dtype)
        near[query, place], doc[query, place] = flat.field("near").to_numpy(), own
        ranks = _Ranks(_matrix(qs["embedding"]), near, doc)
        ranks.add(codes.decode(cell, code), _ids(docs["doc_id"].combine_chunks()), cell, _Probed(qs["probed"], codes.cells))
        better = [x[:m].tobytes() for x, m in zip(ranks.counts().astype("<i8"), sizes.tolist())]
        return pa.table([qs["query_stripe"], qs["number"], pa.array(better, pa.binary())], schema=better_arrow)

    tried = found.groupBy("number").agg(F.collect_list(F.struct("place", "near", "doc_id")).alias("tried"))
    asking = numbered.select("number", "embedding", "probed", "query_stripe").join(tried, "number")
    ranked = stripes.met(["code"], asking, rank, "query_stripe int, number long, better binary")

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        number = table["number"].to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        better = [np.frombuffer(x, "<i8") for x in table["better"].to_pylist()]
        inside = [sum(better[a:b]) < rescore for a, b in zip(begin, [*begin[1:], len(number)])]
        return pa.table({
            "number": number[begin], "inside": pa.array([x.tolist() for x in inside], pa.list_(pa.bool_())),
            "open": pa.array([len(x) == tries and int(x.sum()) < k for x in inside])})

    # A bounded number of queries to a group.
    decided = ranked.groupBy("query_stripe", F.pmod("number", F.lit(16))).applyInArrow(decide, "number long, inside array<boolean>, open boolean")
    decided = materialise(decided, "decided")
    hits = found.join(decided.filter(~F.col("open")), "number").filter(F.element_at("inside", F.col("place"))).select("query_id", "doc_id", "score")
    left = numbered.join(decided.filter("open"), "number", "left_semi").select("query_id", "embedding")
    if n_left := decided.filter("open").count():
        late = _binned(rows, left, codes, k, probes, rescore, decimals, limits, n, n_left)
        hits = hits.unionByName(late.select("query_id", "doc_id", "score"))
    counts = numbered.groupBy("query_id").agg(F.sum("scored").alias("scored"))
    return best_first(hits, k).join(counts, "query_id")


def _binned(
    rows: DataFrame, asked: DataFrame, codes: CellCodes, k: int, probes: int, rescore: int, decimals: int, limits: SizeLimits, n_rows: int, n_asked: int,
) -> DataFrame:
    """The hits of :func:`_striped`, wherever they rank by exact score.

    The first round counts each query's scores by code in bins, which tells the
    bin of the last that is to be scored.  The second scores exactly what lies
    above that bin and keeps k rows per query; of the bin itself it keeps what
    scores as high as those.  For these few, the third counts what has a better
    code.
    """
    shared = rows.sparkSession.sparkContext.broadcast(codes.packed())
    stripes = _Stripes.of(rows, n_rows, n_asked, limits)
    met = stripes.met
    numbered = materialise(stripes.numbered(asked), "numbered")
    doc_type, query_type = rows.schema["doc_id"].dataType, asked.schema["query_id"].dataType
    numbers, docs_arrow = pa.int64(), _arrow_id(doc_type)

    def count(docs: pa.Table, qs: pa.Table) -> pa.Table:
        if not docs.num_rows or not qs.num_rows:
            return pa.table({"query_stripe": pa.array([], pa.int32()), "number": pa.array([], numbers), "bins": pa.array([], pa.binary())})
        pair = _Looked(docs, qs, CellCodes.unpacked(shared.value), probes)
        held = np.zeros((len(pair.asked), _BINS + 1), np.int64)
        for of, _, near in pair.slabs():
            m = len(near)
            at = _bins(near) + np.arange(m, dtype=np.int32)[:, None] * (_BINS + 1)
            held[of] += np.bincount(at.ravel(), minlength=m * (_BINS + 1)).reshape(m, -1)
        cells = [x.tobytes() for x in held[:, 1:].astype("<u4")]
        return pa.table({"query_stripe": pair.qs["query_stripe"], "number": pair.qs["number"], "bins": pa.array(cells, pa.binary())})

    def threshold(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        number = table["number"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        held = np.frombuffer(b"".join(table["bins"].to_pylist()), "<u4").reshape(len(number), _BINS).astype(np.int64)
        above = np.add.reduceat(held, first, axis=0)[:, ::-1].cumsum(1)[:, ::-1]        # in each bin or above
        # Bins count from 1; all above the last is scored, as far as it goes.
        last = np.where(above[:, 0] <= rescore, 0, (above >= rescore).sum(1))
        last -= (last > 0) & (above[np.arange(len(first)), last - 1] == rescore)
        return pa.table({"number": number[first], "last": pa.array(last.astype(np.int32)), "scored": np.minimum(above[:, 0], rescore)})

    counted = met(["code"], numbered, count, "query_stripe int, number long, bins binary")
    # A bounded number of queries to a group.
    counted = counted.groupBy("query_stripe", F.pmod("number", F.lit(16))).applyInArrow(threshold, "number long, last int, scored long")
    known = materialise(numbered.join(materialise(counted, "last-bins"), "number"), "asked")
    hits_schema = f"number long, query_id {query_type.simpleString()}, doc_id {doc_type.simpleString()}, near double, score double, sure boolean"
    hits_arrow = pa.schema([("number", numbers), ("query_id", _arrow_id(query_type)), ("doc_id", docs_arrow), ("near", pa.float64()), ("score", pa.float64()), ("sure", pa.bool_())])

    def score(docs: pa.Table, qs: pa.Table) -> pa.Table:
        if not docs.num_rows or not qs.num_rows:
            return hits_arrow.empty_table()
        pair = _Looked(docs, qs, CellCodes.unpacked(shared.value), probes)
        exact, last = _matrix(pair.docs["embedding"]), pair.qs["last"].to_numpy()
        best = _Best(len(last), k, decimals)
        open_: list[tuple] = []
        for of, at, near in pair.slabs():
            index, bins = np.arange(of.start, of.stop), _bins(near)
            whole = pair.asked[of] @ exact[at].T
            best._slab(np.where(bins > last[of, None], whole, -np.inf), index, pair.doc[at])
            row, col = np.nonzero((bins == last[of, None]) & (bins > 0) & (whole >= best.score[index, -1, None] - 10.0**-decimals))
            found = index[row], near[row, col], pair.doc[at][col], np.round(whole[row, col], decimals) + 0.0, at.start + col
            kept = _few(*found[:4], k) if len(row) else row
            open_.append(tuple(x[kept] for x in found))
        query, near, doc, value, place = (np.concatenate(x) for x in zip(*open_))
        kept = np.flatnonzero(value >= best.score[query, -1])
        kept = kept[_few(query[kept], near[kept], doc[kept], value[kept], k)] if len(kept) else kept
        sure = best.frame(np.arange(len(last)))
        query = np.concatenate([sure["query_id"], query[kept]])
        ids = pa.concat_arrays([pa.array(sure["doc_id"], docs_arrow), pair.docs["doc_id"].combine_chunks().take(pa.array(place[kept])).cast(docs_arrow)])
        take = pa.array(query)
        return pa.table([
            pair.qs["number"].take(take), pair.qs["query_id"].take(take), ids, pa.array(np.concatenate([np.zeros(len(sure["score"])), near[kept]])),
            pa.array(np.concatenate([sure["score"], value[kept]])), pa.array(np.arange(len(query)) < len(sure["score"])),
        ], schema=hits_arrow)

    scored = materialise(met(["code", "embedding"], known.drop("scored"), score, hits_schema), "scored")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    sure = materialise(scored.filter("sure").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "sure")
    kth = sure.filter(F.col("rank") == k).select("number", F.col("score").alias("kth"))
    maybe = scored.filter(~F.col("sure")).join(kth, "number", "left").filter(F.col("kth").isNull() | (F.col("score") >= F.col("kth"))).drop("kth")
    maybe = materialise(maybe, "open")
    better_arrow = pa.schema([("number", numbers), ("doc_id", docs_arrow), ("near", pa.float64()), ("better", numbers)])

    def rank(docs: pa.Table, qs: pa.Table) -> pa.Table:
        if not docs.num_rows or not qs.num_rows:
            return better_arrow.empty_table()
        pair = _Looked(docs, qs, CellCodes.unpacked(shared.value), probes)
        tried = [(np.array([t["near"] for t in x]), _ids(pa.array([t["doc_id"] for t in x], docs_arrow))) for x in pair.qs["tried"].to_pylist()]
        better = [np.zeros(len(x), np.int64) for x, _ in tried]
        for of, at, near in pair.slabs():
            doc = pair.doc[at]
            for q, row in zip(range(of.start, of.stop), near):
                for c, (value, own) in enumerate(zip(*tried[q])):
                    better[q][c] += np.count_nonzero(row > value) + np.count_nonzero(doc[row == value] < own)
        sizes = [len(x) for x in better]
        return pa.table([
            pair.qs["number"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.concat_arrays([pa.array(d, docs_arrow) for _, d in tried]),
            pa.array(np.concatenate([x for x, _ in tried])), pa.array(np.concatenate(better)),
        ], schema=better_arrow)

    tried = maybe.select("number", "doc_id", "near").distinct().groupBy("number").agg(F.collect_list(F.struct("doc_id", "near")).alias("tried"))
    ranked = met(["code"], numbered.join(tried, "number"), rank, f"number long, doc_id {doc_type.simpleString()}, near double, better long")
    inside = ranked.groupBy("number", "doc_id", "near").agg(F.sum("better").alias("better")).filter(F.col("better") < rescore).drop("better")
    late = maybe.join(inside, ["number", "doc_id", "near"], "left_semi")
    both = sure.select("query_id", "doc_id", "score").unionByName(late.select("query_id", "doc_id", "score"))
    counts = known.groupBy("query_id").agg(F.sum("scored").alias("scored"))
    return best_first(both, k).join(counts, "query_id")


def nearest_coded(
    rows: DataFrame, queries: DataFrame, codes: CellCodes, k: int, *, probes: int, rescore: int,
    decimals: int = RetrievalConfig.decimals, limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """Approximate cosine top-k: ``query_id, doc_id, score, rank`` and ``scored``, the vectors scored exactly for the query.

    ``rows`` are coded vectors, best stored by cell.  Queries beyond the limit
    are answered in blocks.  Where the pairs to score exactly are beyond it, they
    stay in the tasks that find them.
    """
    asked = queries.select("query_id", "embedding").filter(F.size("embedding") > 0)
    size, rescore = measure(asked), max(k, rescore)
    if size.rows * rescore * _PAIR > limits.broadcast_bytes:
        return _striped(rows, asked, codes, k, probes, rescore, decimals, limits, size.rows)
    blocks = size.blocks(limits.broadcast_bytes)
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = [_survivors(rows, asked.filter(part == n) if blocks > 1 else asked, codes, probes, rescore) for n in range(blocks)]
    survivors = found[0]
    for more in found[1:]:
        survivors = survivors.unionByName(more)
    survivors = materialise(survivors, "survivors")
    # The few pairs go to where the exact vectors are.
    # True for every cell, but Spark prunes folders at run time only by a side with a filter.
    pairs = rows.select("doc_id", "cell", "embedding").join(broadcast_if_small(survivors.filter("cell >= 0"), limits.broadcast_bytes), ["cell", "doc_id"])
    pairs = pairs.join(broadcast_if_small(asked.select("query_id", F.col("embedding").alias("asked")), limits.broadcast_bytes), "query_id")
    schema = _hit_schema(rows, queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.round((_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(1), decimals) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "doc_id", "score"])

    scored = pairs.select("query_id", "doc_id", "embedding", "asked").mapInArrow(run, schema)
    counts = survivors.groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"))
    return best_first(scored, k).join(broadcast_if_small(counts, limits.broadcast_bytes), "query_id")


def calibrated(rows: DataFrame, codes: CellCodes, k: int = 20, target: float = 0.95) -> tuple[int, int]:
    """``probes`` and ``rescore`` that reach the target recall for ``TRIALS`` stored vectors, against exact search.

    The probes follow from where the exact neighbours lie; rescoring doubles
    until the recall is there.  The trials and their neighbours reach the driver.
    """
    trials = materialise(rows.select(F.col("doc_id").alias("query_id"), "embedding").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRIALS), "trials")
    exact = materialise(nearest(rows, trials, k).drop("score"), "neighbours")
    cells = rows.select("doc_id", "cell").join(F.broadcast(exact), "doc_id").select("query_id", "cell").toArrow()
    asked = trials.toArrow()
    order = np.argsort(codes.probe(_matrix(asked["embedding"]), codes.cells), axis=1)
    number = {q: n for n, q in enumerate(asked["query_id"].to_pylist())}
    ranks = np.sort([order[number[q], c] for q, c in zip(cells["query_id"].to_pylist(), cells["cell"].to_pylist())])
    # Half of what may be lost is left to the codes.
    probes = int(ranks[ceil((1 + target) / 2 * len(ranks)) - 1]) + 1
    n, rescore = rows.count(), 2 * k
    while rescore < n:
        found = nearest_coded(rows, trials, codes, k, probes=probes, rescore=rescore)
        if recall_at_k(found, exact).agg(F.avg("recall")).first()[0] >= target:
            break
        rescore *= 2
    return probes, min(rescore, n)
