"""Cosine top-k: exact, filtered, and approximate over cells.

Every plan scores vectors where they lie and keeps ``k`` rows per query and
task, so what is shuffled is ``tasks x queries x k`` short rows and never the
pairs.  Vectors move only in the block plan, which takes over when the query
side is measured to be too large to send to every task: there they go to the
query blocks near enough to hold them among their hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..config import RetrievalConfig, SizeLimits
from ..functions.numbers import rounded
from ..session import materialise
from .documents import where as apply_where
from .sizing import measure

_CELLS = 1 << 20        # scores held at once inside a task
_PAIRS = 1 << 14        # pairs of vectors copied at once
_LEAST = -np.finfo(np.float64).max
_LOWEST = np.finfo(np.float32).min
_QUERIES = 256          # queries scored at once
#: Stripes of the query and of the vector side: at least as many as the first numbers (where there are as many blocks of rows),
#: so every row is sent a fixed number of times; more only beyond STRIPE_ROWS rows of one.
Q_STRIPES, V_STRIPES, STRIPE_ROWS = 24, 4, 65_536
_PIVOTS = 1024          # blocks of one side at most; larger blocks are split
_PER_PIVOT = 8          # vectors that each pivot is chosen from


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as unit-length rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(values.reshape(rows, -1))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _ids(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def product_error(dim: int) -> float:
    """How far a product of unit vectors in single precision can be off."""
    return (dim + 8) * 2.0**-24


class Products:
    """Single-precision products of some rows with many others, a slab at a time in the same memory."""

    def __init__(self, rows: np.ndarray, cells: int):
        self.rows, self.step = rows, max(8, cells // max(1, len(rows)) // 8 * 8)
        self.near, self.flags = np.empty(len(rows) * self.step, np.float32), np.empty(len(rows) * self.step, bool)

    def of(self, others: np.ndarray) -> np.ndarray:
        return np.matmul(self.rows, others.T, out=self.near[:len(self.rows) * len(others)].reshape(len(self.rows), len(others)))

    def reach(self, near: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of what is not below the bound of its row."""
        flags = self.flags[:near.size]
        np.greater_equal(near, least.astype(np.float32)[:, None], out=flags.reshape(near.shape))
        if near.size % 8:
            found = np.flatnonzero(flags)
        else:
            # Mostly none of eight.
            eight = np.flatnonzero(flags.view(np.uint64))
            place, one = np.nonzero(flags.reshape(-1, 8)[eight])
            found = eight[place] * 8 + one
        return np.divmod(found, near.shape[1])


def products(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Products of the given pairs in double precision."""
    if 64 * len(row) > len(a) * len(b):
        return (a @ b.T)[row, col]
    return np.concatenate([np.einsum("ij,ij->i", a[row[n:n + _PAIRS]], b[col[n:n + _PAIRS]]) for n in range(0, max(1, len(row)), _PAIRS)])


class _Best:
    """The k best (score, doc) of ``n`` queries seen so far, ties to the smaller id."""

    def __init__(self, n: int, k: int, decimals: int):
        self.k, self.decimals = k, decimals
        self.score = np.full((n, k), -np.inf)
        self.doc: np.ndarray | None = None

    def add(
        self, queries: np.ndarray, query_index: np.ndarray, docs: np.ndarray, vectors: np.ndarray,
        probed: np.ndarray | None = None, cell: np.ndarray | None = None,
    ) -> None:
        """Of unit vectors; with ``probed`` (queries x cells) and the ``cell`` of each vector, pairs in probed cells only.

        Products in single precision tell which few pairs can be among the best; these are scored in double precision.
        """
        near_q, near_v = queries.astype(np.float32), vectors.astype(np.float32)
        slack = 10.0**-self.decimals + 2 * product_error(queries.shape[1])
        for begin in range(0, len(queries), _QUERIES):
            at = slice(begin, begin + _QUERIES)
            index, looked = query_index[at], None if probed is None else probed[at]
            scores, held, waiting = Products(near_q[at], _CELLS), [], 0
            for start in range(0, len(docs), scores.step):
                to = slice(start, start + scores.step)
                near = scores.of(near_v[to])
                least = np.maximum(self.score[index, -1], _LOWEST)
                if (least == _LOWEST).any():
                    if looked is not None:
                        near[~looked[:, cell[to]]] = -np.inf
                    if near.shape[1] > self.k:
                        least = np.maximum(least, np.partition(near, near.shape[1] - self.k, axis=1)[:, -self.k])
                row, col = scores.reach(near, np.maximum(least - slack, _LOWEST))
                if looked is not None:
                    inside = looked[row, cell[to][col]]
                    row, col = row[inside], col[inside]
                if len(row):
                    held.append((index[row], docs[to][col], np.round(products(queries[at], vectors[to], row, col), self.decimals) + 0.0))
                    waiting += len(row)
                # The bound rises slowly: what is found may wait until there is as much of it as is held.
                if waiting >= len(index) * self.k or held and to.stop >= len(docs):
                    self._merge(*(np.concatenate(x) for x in zip(*held)))
                    held, waiting = [], 0

    def _slab(self, scores: np.ndarray, index: np.ndarray, docs: np.ndarray) -> None:
        # Scores are rounded before ranking: what is a step below the bound may still reach it.
        least = np.maximum(self.score[index, -1], _LEAST)
        if scores.shape[1] > self.k and (least == _LEAST).any():
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(scores >= least[:, None] - 10.0**-self.decimals)
        if len(row):
            self._merge(index[row], docs[col], np.round(scores[row, col], self.decimals) + 0.0)

    def _merge(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        if self.doc is None:
            self.doc = np.zeros(self.score.shape, doc.dtype)
        self.doc = self.doc.astype(np.result_type(self.doc, doc), copy=False)
        changed = np.unique(query)
        row, col = np.nonzero(self.score[changed] > -np.inf)
        query = np.concatenate([changed[row], query])
        doc = np.concatenate([self.doc[changed[row], col], doc])
        score = np.concatenate([self.score[changed[row], col], score])
        order = np.lexsort((doc, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = place < self.k
        query, place, order = query[keep], place[keep], order[keep]
        self.doc[query, place], self.score[query, place] = doc[order], score[order]

    def frame(self, query_ids: np.ndarray) -> dict[str, np.ndarray]:
        row, col = np.nonzero(self.score > -np.inf)
        doc = np.zeros(0, dtype=np.int64) if self.doc is None else self.doc[row, col]
        return {"query_id": query_ids[row], "doc_id": doc, "score": self.score[row, col]}


def _hit_schema(vectors: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", vectors.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def best_first(hits: DataFrame, k: int) -> DataFrame:
    """Rank hits per query by score, ties by document, and keep ``k``.

    The row-number filter becomes ``WindowGroupLimit``: each task drops all but
    ``k`` rows per query before they are shuffled.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, *, where: dict[str, object] | None = None,
    decimals: int = RetrievalConfig.decimals, limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """Exact cosine top-k of every query: ``query_id, doc_id, score, rank``.

    ``vectors`` has ``doc_id, embedding``, ``queries`` has ``query_id,
    embedding``.  ``where`` filters before scoring, so k hits come back
    whenever k vectors qualify.
    """
    vectors = apply_where(vectors, where).select("doc_id", "embedding").filter(F.size("embedding") > 0)
    queries = queries.select("query_id", "embedding").filter(F.size("embedding") > 0)
    if measure(queries).bytes <= limits.broadcast_bytes:
        partial = _scan(vectors, queries, k, decimals)
    else:
        partial = _blocks(vectors, queries, k, decimals, limits.block_rows)
    return best_first(partial, k)


def _fetch(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The query side as arrays; called only below the broadcast limit."""
    table = queries.toArrow()
    return _ids(table.column("query_id").combine_chunks()), _matrix(table.column("embedding"))


def _scan(vectors: DataFrame, queries: DataFrame, k: int, decimals: int) -> DataFrame:
    """All queries in every task; vectors are read once and stay in place."""
    schema = _hit_schema(vectors, queries)
    shared = vectors.sparkSession.sparkContext.broadcast(_fetch(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = _Best(len(ids), k, decimals)
        for batch in batches:
            if batch.num_rows and len(ids):
                best.add(matrix, np.arange(len(ids)), _ids(batch.column(0)), _matrix(batch.column(1)))
        if best.doc is not None:
            yield pa.RecordBatch.from_pydict(best.frame(ids))

    return vectors.mapInArrow(run, schema)


@dataclass(frozen=True)
class _Side:
    """Rows with the block and the stripe they lie in; for each block its rows, the largest angle to its pivot, and its stripes."""

    rows: DataFrame
    count: np.ndarray
    radius: np.ndarray
    stripes: list[list[int]]


def stripe_count(n: int, block_rows: int, least: int) -> int:
    """Stripes for ``n`` rows: ``least``, fewer where rows are few, more where a stripe would hold too many."""
    return max(1, min(least, -(-n // block_rows)), -(-n // STRIPE_ROWS))


def _farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before it, so that no group of vectors is far from all."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _blocked(rows: DataFrame, key: str, pivots: np.ndarray, block_rows: int, n: int, least: int) -> _Side:
    """Rows in the block of their nearest pivot, and in stripes: runs of blocks with about as many rows each.

    A block that holds more than a stripe is spread over several by a hash of the key.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(1)) @ shared.value.T
                block = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(block)), block], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "block", "angle"])

    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    placed = materialise(rows.mapInArrow(run, schema), "blocked")
    # A row per block, of which there are at most _PIVOTS.
    count, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for row in placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():
        count[row["block"]], radius[row["block"]] = row["n"], row["r"]
    stripes = stripe_count(n, block_rows, least)
    share = max(1.0, count.sum() / stripes)
    dealt: list[list[int]] = [[] for _ in pivots]
    before = 0.0
    # The first pivots are far from each other: what is nearest to one of them lies together.
    for block in np.lexsort((np.arange(len(pivots)), (pivots @ pivots[:stripes].T).argmax(1))).tolist():
        parts = int(np.ceil(count[block] / share))
        dealt[block] = [min(stripes - 1, int((before + (p + 0.5) * count[block] / parts) / share)) for p in range(parts)]
        before += count[block]
    table = F.broadcast(spark.createDataFrame([(b, d) for b, d in enumerate(dealt) if d], "block int, dealt array<int>"))
    stripe = F.element_at("dealt", (F.pmod(F.xxhash64(key), F.size("dealt")) + 1).cast("int"))
    return _Side(placed.drop("angle").join(table, "block").withColumn("stripe", stripe).drop("dealt"), count, radius, dealt)


def _sent(side: _Side, other: _Side, wanted: np.ndarray, own: str, to: str) -> DataFrame:
    """Rows with ``own``, their stripe, and ``to``: a row for every stripe of the other side with a block that theirs is to meet."""
    stripes = 1 + max((s for d in other.stripes for s in d), default=0)
    holds = np.zeros((len(other.stripes), stripes), bool)
    for block, dealt in enumerate(other.stripes):
        holds[block, dealt] = True
    needed = (wanted.astype(np.float32) @ holds) > 0
    table = [(b, np.flatnonzero(row).tolist()) for b, row in enumerate(needed) if row.any()]
    table = F.broadcast(side.rows.sparkSession.createDataFrame(table, f"block int, {to} array<int>"))
    return side.rows.join(table, "block").withColumnRenamed("stripe", own).withColumn(to, F.explode(to))


def _met(vectors: _Side, queries: _Side, wanted: np.ndarray, k: int, decimals: int, schema: T.StructType) -> DataFrame:
    """The k best hits of every query in the wanted blocks (query block x vector block), a task per pair of stripes.

    A row goes once to each stripe that holds a block it is to meet, not once to each block.
    """
    spark = vectors.rows.sparkSession
    shared = spark.sparkContext.broadcast(wanted)
    keys = ("vector_stripe", "query_stripe")
    left = _sent(vectors, queries, wanted.T, *keys).select(*keys, "block", "doc_id", "embedding")
    right = _sent(queries, vectors, wanted, *keys[::-1]).select(*keys, "block", "query_id", "embedding")
    arrow_schema = pa.schema([
        ("query_id", _arrow_id(schema["query_id"].dataType)), ("doc_id", _arrow_id(schema["doc_id"].dataType)),
        ("score", pa.float64()),
    ])

    def run(docs: pa.Table, qs: pa.Table) -> pa.Table:
        if not docs.num_rows or not qs.num_rows:
            return arrow_schema.empty_table()
        docs, qs = docs.sort_by("block"), qs.sort_by("block")
        ids, held = _ids(qs.column("query_id").combine_chunks()), _ids(docs.column("doc_id").combine_chunks())
        asked, matrix = _matrix(qs.column("embedding")), _matrix(docs.column("embedding"))
        of_query, of_doc = qs.column("block").to_numpy(), docs.column("block").to_numpy()
        best = _Best(len(ids), k, decimals)
        for block in np.unique(of_query):
            at = np.arange(*np.searchsorted(of_query, [block, block + 1]))
            meets = shared.value[block][of_doc]
            if meets.all():
                best.add(asked[at], at, held, matrix)
            elif meets.any():
                best.add(asked[at], at, held[meets], matrix[meets])
        return pa.Table.from_pydict(best.frame(ids)).cast(arrow_schema) if best.doc is not None else arrow_schema.empty_table()

    # A number of partitions that adaptive execution keeps: stripes are few bytes and much work.
    tasks = sum(1 + max((s for d in side.stripes for s in d), default=0) for side in (vectors, queries)) * V_STRIPES
    parts = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left, right = (x.repartition(parts, *keys).groupBy(*keys) for x in (left, right))
    return left.cogroup(right).applyInArrow(run, schema)


def _blocks(vectors: DataFrame, queries: DataFrame, k: int, decimals: int, block_rows: int, log: dict | None = None) -> DataFrame:
    """Both sides in blocks around pivots; pairs of blocks that cannot hold a hit never meet.

    A block is a cap: its pivot and the largest angle to it.  Two caps bound the
    cosine of everything in them.  In the first round each block of queries
    meets the nearest vector blocks that hold k vectors; the k-th scores there are
    what a hit needs.  In the second it meets the blocks whose bound reaches the
    least of them.  Exact; ``log`` receives the numbers of pairs.
    """
    schema = _hit_schema(vectors, queries)
    n_vec, n_qry = vectors.count(), queries.count()
    if not n_vec or not n_qry:
        return vectors.sparkSession.createDataFrame([], schema)
    wanted = min(_PIVOTS, max(1, -(-n_vec // block_rows)))
    order = F.xxhash64("doc_id")
    chosen = vectors.filter(F.exists("embedding", lambda x: x != 0)).select("embedding", order.alias("o"), "doc_id").orderBy("o", "doc_id").limit(_PER_PIVOT * wanted).toArrow()
    pivots = _farthest_first(_matrix(chosen.column("embedding")), wanted) if chosen.num_rows else None
    if pivots is None:
        # Zero vectors only: every score is 0, any pivot serves.
        width = vectors.select(F.max(F.size("embedding"))).first()[0] or 1
        pivots = np.ones((1, width)) / np.sqrt(width)
    vs = _blocked(vectors, "doc_id", pivots, block_rows, n_vec, V_STRIPES)
    qs = _blocked(queries, "query_id", pivots, block_rows, n_qry, Q_STRIPES)
    held, asking = np.flatnonzero(vs.count), np.flatnonzero(qs.count)
    apart = np.arccos(np.clip(pivots[asking] @ pivots[held].T, -1, 1))
    near = np.argsort(apart, axis=1, kind="stable")
    enough = (np.cumsum(vs.count[held][near], axis=1) < k).sum(axis=1) + 1
    first = np.zeros(apart.shape, bool)
    np.put_along_axis(first, near, np.arange(len(held)) < enough[:, None], axis=1)

    def pairs(of: np.ndarray) -> np.ndarray:
        every = np.zeros((len(pivots), len(pivots)), bool)
        every[np.ix_(asking, held)] = of
        return every

    found = materialise(best_first(_met(vs, qs, pairs(first), k, decimals, schema), k), "first-pairs")
    kth = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    least = qs.rows.select("query_id", "block").join(kth, "query_id", "left").groupBy("block").agg(F.min(F.coalesce("kth", F.lit(-2.0))).alias("least"))
    needed = np.full(len(pivots), -2.0)
    for row in least.collect():
        needed[row["block"]] = row["least"]
    bound = np.cos(np.maximum(0, apart - qs.radius[asking][:, None] - vs.radius[held][None, :]))
    second = ~first & (bound + 10.0**-decimals >= needed[asking][:, None])
    if log is not None:
        log.update(first=int(first.sum()), second=int(second.sum()), all=first.size)
    found = found.drop("rank")
    return found.unionByName(_met(vs, qs, pairs(second), k, decimals, schema)) if second.any() else found


def _arrow_id(dtype: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dtype.simpleString()]


def nearest_post_filtered(
    vectors: DataFrame, queries: DataFrame, k: int, where: dict[str, object], *, overfetch: int = 3,
    decimals: int = RetrievalConfig.decimals, limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """Top ``overfetch * k`` first, filter afterwards: may return fewer than k."""
    wide = nearest(vectors, queries, k * overfetch, decimals=decimals, limits=limits)
    allowed = apply_where(vectors, where).select("doc_id")
    return best_first(wide.drop("rank").join(allowed, "doc_id", "left_semi"), k)


# ---------------------------------------------------------------------------
# Approximate search over cells
# ---------------------------------------------------------------------------

class PlaneCells:
    """Sign patterns against fixed hyperplanes.

    Plane ``p`` has the component +1 or -1 in dimension ``d`` by the parity of
    the first hex digit of ``md5("p:d")``, so cells can be recomputed anywhere.
    A query looks at its own cell and the ``probes - 1`` cells whose border it
    is closest to (one sign flipped).
    """

    def __init__(self, dim: int, planes: int = 4):
        self.matrix = np.array([
            [1.0 if int(hashlib.md5(f"{p}:{d}".encode()).hexdigest()[0], 16) % 2 == 0 else -1.0 for d in range(dim)]
            for p in range(planes)
        ])

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        bits = (np.round(vectors @ self.matrix.T, 9) >= 0).astype(np.int64)
        return (bits << np.arange(len(self.matrix))).sum(axis=1)

    def probe(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        margins = np.abs(np.round(vectors @ self.matrix.T, 9))
        nearest_border = np.argsort(margins, axis=1, kind="stable")[:, :max(0, probes - 1)]
        own = self.assign(vectors)[:, None]
        return np.concatenate([own, own ^ (1 << nearest_border)], axis=1)


class CentroidCells:
    """Cells around centroids; a query looks at its ``probes`` nearest ones."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, dtype=np.float64)

    def _distances(self, vectors: np.ndarray) -> np.ndarray:
        return (self.centroids ** 2).sum(axis=1) - 2 * vectors @ self.centroids.T

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        return self._distances(vectors).argmin(axis=1).astype(np.int64)

    def probe(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(self._distances(vectors), axis=1, kind="stable")[:, :probes].astype(np.int64)


def train_cells(vectors: DataFrame, cells: int, *, seed: int = 7, iterations: int = 10) -> CentroidCells:
    """Centroids by Spark's k-means over unit vectors (distributed training).

    Only ``cells x dim`` numbers reach the driver.  Training may be given a
    part of a very large table: centroids steer the search, they never drop
    a vector from it.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.vectors import normalise

    features = normalise(vectors.select("embedding"), "embedding").select(
        array_to_vector("embedding").alias("features")
    )
    model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(features)
    return CentroidCells(np.array(model.clusterCenters()))


def assign_cells(vectors: DataFrame, cells: PlaneCells | CentroidCells) -> DataFrame:
    """Add the ``cell`` of every vector (narrow, no shuffle)."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.LongType())])
    position = vectors.columns.index("embedding")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cells.assign(_matrix(batch.column(position)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"]
                )

    return vectors.mapInArrow(run, schema)


def write_cells(celled: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Store assigned vectors in one folder per cell.

    Large cells are written by several tasks, as many as their measured size
    asks for.  A search over the stored table reads only the probed folders.
    """
    # One row per cell, as many as there are centroids or sign patterns.
    parts = F.broadcast(celled.groupBy("cell").count().select(
        "cell", F.ceil(F.col("count") / file_rows).cast("int").alias("__files")
    ))
    spread = celled.join(parts, "cell").withColumn("__file", F.pmod(F.xxhash64("doc_id"), F.col("__files")))
    spread.repartition("cell", "__file").drop("__files", "__file").write.mode("overwrite").partitionBy("cell").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("cell", F.col("cell").cast("long"))


def probe_cells(queries: DataFrame, cells: PlaneCells | CentroidCells, probes: int) -> DataFrame:
    """``query_id, embedding, cell``: one row per query and cell to search."""
    schema = T.StructType([
        queries.schema["query_id"], queries.schema["embedding"], T.StructField("cell", T.LongType()),
    ])
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                matrix = _unit(np.stack(batch["embedding"].to_numpy()).astype(np.float64))
                batch["cell"] = list(cells.probe(matrix, probes))
                yield batch.explode("cell").astype({"cell": "int64"})

    return queries.select("query_id", "embedding").mapInPandas(run, schema)


def nearest_approximate(
    celled: DataFrame, queries: DataFrame, k: int, cells: PlaneCells | CentroidCells, *, probes: int = 4,
    decimals: int = RetrievalConfig.decimals, limits: SizeLimits = SizeLimits(),
) -> DataFrame:
    """Cosine top-k among the vectors of the probed cells, exactly rescored.

    ``celled`` comes from :func:`assign_cells`, best stored clustered by
    ``cell`` so that unprobed cells are skipped by the scan.
    """
    probed = probe_cells(queries.filter(F.size("embedding") > 0), cells, probes)
    celled = celled.select("doc_id", "embedding", "cell").filter(F.size("embedding") > 0)
    size = measure(probed)
    if size.bytes <= limits.broadcast_bytes:
        partial = _scan_cells(celled, probed, k, decimals)
    else:
        partial = _cell_blocks(celled, probed, k, decimals, limits.block_rows)
    return best_first(partial, k)


def _scan_cells(celled: DataFrame, probed: DataFrame, k: int, decimals: int) -> DataFrame:
    schema = _hit_schema(celled, probed)
    table = probed.toArrow()
    ids, index = np.unique(_ids(table.column("query_id").combine_chunks()), return_inverse=True)
    shared = celled.sparkSession.sparkContext.broadcast((
        ids, index, table.column("cell").to_numpy(), _matrix(table.column("embedding")),
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, index, cell_of, matrix = shared.value
        best = _Best(len(ids), k, decimals)
        for batch in batches:
            cell = batch.column(2).to_numpy()
            docs, vectors = _ids(batch.column(0)), _matrix(batch.column(1))
            for c in np.unique(cell):
                rows, asking = cell == c, cell_of == c
                if asking.any():
                    best.add(matrix[asking], index[asking], docs[rows], vectors[rows])
        if best.doc is not None:
            yield pa.RecordBatch.from_pydict(best.frame(ids))

    wanted = probed.select("cell").distinct()
    return celled.join(F.broadcast(wanted), "cell", "left_semi").select("doc_id", "embedding", "cell").mapInArrow(run, schema)


def _cell_blocks(celled: DataFrame, probed: DataFrame, k: int, decimals: int, block_rows: int) -> DataFrame:
    """Cells cut into blocks by their measured sizes, so no hot cell is one task and every row is sent a few times only."""
    schema = _hit_schema(celled, probed)

    def cut(side: DataFrame, least: int, out: str) -> DataFrame:
        n = F.col("count")
        blocks = F.greatest(F.least(F.lit(least), F.ceil(n / block_rows)), F.ceil(n / STRIPE_ROWS))
        return side.groupBy("cell").count().select("cell", blocks.cast("int").alias(out))

    # One row per cell: bounded by the number of centroids or sign patterns.
    plan = F.broadcast(cut(celled, V_STRIPES, "nv").join(cut(probed, V_STRIPES, "nq"), "cell"))
    left = celled.join(plan, "cell").select(
        "cell", F.pmod(F.xxhash64("doc_id"), F.col("nv")).cast("int").alias("bv"),
        F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), "doc_id", "embedding",
    )
    right = probed.join(plan, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("bv"),
        F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("bq"), "query_id", "embedding",
    )
    keys = ("cell", "bv", "bq")
    arrow_schema = pa.schema([
        ("query_id", _arrow_id(schema["query_id"].dataType)), ("doc_id", _arrow_id(schema["doc_id"].dataType)),
        ("score", pa.float64()),
    ])

    def run(docs: pa.Table, qs: pa.Table) -> pa.Table:
        if not docs.num_rows or not qs.num_rows:
            return arrow_schema.empty_table()
        ids = _ids(qs.column("query_id").combine_chunks())
        best = _Best(len(ids), k, decimals)
        best.add(
            _matrix(qs.column("embedding")), np.arange(len(ids)),
            _ids(docs.column("doc_id").combine_chunks()), _matrix(docs.column("embedding")),
        )
        return pa.Table.from_pydict(best.frame(ids)).cast(arrow_schema) if best.doc is not None else arrow_schema.empty_table()

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that an approximate search found, per query."""
    common = exact.select("query_id", "doc_id").join(
        found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left"
    )
    return common.groupBy("query_id").agg(
        rounded(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall")
    )
