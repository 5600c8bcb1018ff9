"""Exact top-k inner products with vector-approximation files.

Every vector is stored twice: exactly, and as one small cell number for each
component.  Cell edges bound each component, so they bound the inner product
with any query.  A search scans the cells of a block, reads exact vectors in the
order of their bounds, and stops once the k-th score is out of reach of all
vectors not yet read.  Ties are read too, so the result is exact.

Vectors are dealt to blocks of about ``BLOCK`` rows by a hash of their id.  Each
block of queries meets each block of vectors once (a stated query set against
all rows), a task per pair; a task returns at most k rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.sizing import measure

BLOCK = 4096
QUERY_BLOCK = 1024
BITS = 4
#: Query blocks up to so many bytes go to every task; beyond it both sides are shuffled to their pairs of blocks.
BROADCAST_BYTES = 32 << 20

_PACKED = "block int, n int, dims int, ids binary, vectors binary"


def whole_numbers(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component as array<long>; null if the vector or a component is null or not finite."""
    c = F.col(vector)
    fine = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack(table: pa.Table) -> pa.Table:
    """A block as one row; equal rows count once."""
    ids, vectors = table["id"].to_numpy(), _matrix(table["vector"])
    rows = np.unique(np.column_stack((ids, vectors)), axis=0)
    return pa.table({
        "block": pa.array([table["block"][0].as_py()], pa.int32()), "n": pa.array([len(rows)], pa.int32()),
        "dims": pa.array([vectors.shape[1]], pa.int32()),
        "ids": pa.array([rows[:, 0].tobytes()]), "vectors": pa.array([rows[:, 1:].tobytes()]),
    })


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows (id, vector array<long>) as one row for each of ``blocks`` blocks."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_pack, _PACKED)


class Cells:
    """Vectors as cell numbers, with the least and largest value of each cell."""

    def __init__(self, vectors: np.ndarray, bits: int = BITS):
        low, high = (vectors.min(0), vectors.max(0)) if len(vectors) else (np.zeros(vectors.shape[1], np.int64),) * 2
        span = np.maximum(high.astype(np.float64) - low, 1.0)
        self.low, self.width, self.most = low.astype(np.float64), span / (1 << bits), high.astype(np.float64)
        offset = vectors - self.low
        self.numbers = np.minimum(np.floor(offset / self.width), (1 << bits) - 1).astype(np.uint8)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        lower = self.low + self.numbers * self.width
        return lower, np.minimum(lower + self.width, self.most)


def _scores(queries: np.ndarray, vectors: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products of rows; sums beyond 64 bits become the nearest long."""
    if not wide:
        return np.einsum("ij,ij->i", queries, vectors)
    exact = (queries.astype(object) * vectors.astype(object)).sum(1) if queries.shape[1] else np.zeros(len(queries), object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of a block for each query: positions of queries, ids and scores."""
    dims = max(queries.shape[1], vectors.shape[1])
    queries = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
    vectors = np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))
    n, m = len(ids), len(queries)
    if not n or not m:
        return (np.zeros(0, np.int64),) * 3
    size = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(dims, 1)
    wide = size >= 2**62
    lower, upper = Cells(vectors).edges()
    q = queries.astype(np.float64)
    bound = np.maximum(q, 0) @ upper.T + np.minimum(q, 0) @ lower.T
    bound += 1e-9 + size * 1e-14  # rounding of sums and of cell edges
    bound[query_ids[:, None] == ids[None, :]] = -np.inf
    first = min(n, 4 * k)
    seen = np.argpartition(bound, n - first, axis=1)[:, n - first:]
    row = np.repeat(np.arange(m), first)
    col = seen.ravel()
    allowed = bound[row, col] > -np.inf
    row, col = row[allowed], col[allowed]
    score = _scores(queries[row], vectors[col], wide)
    certain = np.full(m, -np.inf)
    if first >= k:
        table = np.full((m, first), -np.inf)
        table.ravel()[np.flatnonzero(allowed)] = score
        certain = np.partition(table, first - k, axis=1)[:, first - k]
    np.put_along_axis(bound, seen, -np.inf, axis=1)
    more_row, more_col = np.nonzero((bound >= certain[:, None] - size * 1e-14) & (bound > -np.inf))
    found = [score]
    for at in range(0, len(more_row), 1 << 16):
        part = slice(at, at + (1 << 16))
        found.append(_scores(queries[more_row[part]], vectors[more_col[part]], wide))
    row, col, score = np.concatenate((row, more_row)), np.concatenate((col, more_col)), np.concatenate(found)
    order = np.lexsort((ids[col], -score.astype(object) if wide else -score, row))
    row, col, score = row[order], col[order], score[order]
    begin = np.searchsorted(row, np.arange(m))
    best = np.arange(len(row)) - begin[row] < k
    return row[best], ids[col[best]], score[best]


def _unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}vectors"], np.int64).reshape(len(ids), row[f"{prefix}dims"])


def topk(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k largest integer inner products of every query with all rows of another id.

    Components are floor(scale * x).  Returns query_id, rank (from 1), vec_id
    and score; ties go to the smaller id.  Rows whose id or vector is null, or
    that hold null or non-finite components, take no part.  Shorter vectors are
    filled up with zeros; an empty one scores 0.  Equal rows count once, rows of
    one id with different vectors are candidates of their own.  With fewer than
    k candidates all are returned; empty inputs give an empty result.  Other
    columns are ignored.
    """
    def prepared(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), whole_numbers(vector, scale).alias("vector"))
        return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull())

    rows, asked = prepared(vectors), prepared(queries)
    count, size = rows.count(), measure(asked)
    blocks, parts = ceil(count / BLOCK) or 1, ceil(size.rows / QUERY_BLOCK) or 1
    names = {c: f"q_{c}" for c in ("block", "n", "dims", "ids", "vectors")}
    wanted = packed(asked, parts).withColumnsRenamed(names)
    pairs = packed(rows, blocks).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if size.rows * 16 <= BROADCAST_BYTES and size.bytes <= BROADCAST_BYTES:
        pairs = pairs.join(F.broadcast(wanted), "q_block")
    else:
        pairs = pairs.join(wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["block", "q_block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (qid, q), (ids, v) = _unpacked(row, "q_"), _unpacked(row)
                at, vec, score = search_block(qid, q, ids, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    best = pairs.select("ids", "vectors", "dims", "q_ids", "q_vectors", "q_dims").mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
