"""BM25 over posting blocks with largest saturations.

Documents are packed into chunks where they are read: one row per (chunk, term)
with the places of the documents in the chunk and their frequencies, and one row
per chunk (a null term) with ids, lengths and metadata.  ``BLOCK`` consecutive
places are a block.  For each block a posting row keeps the (frequency, length)
pairs that no other pair of the block beats, so the largest saturation of the
block is exact for any average length.

A search takes two rounds.  In the first, every chunk opens the most promising
block of each question; the k-th best score of all chunks is the question's
threshold.  The second opens only blocks whose bound, the sum of largest
saturations times weights, reaches the threshold, and reads only chunks that
have one.  All postings of a chunk meet in one task, so scores need no shuffle of
(question, document) pairs.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..config import LexicalConfig, RetrievalConfig, SizeLimits
from ..functions.text import tokens
from ..session import materialise
from .lexical import Corpus, corpus_statistics, idf, read_corpus
from .nearest import best_first
from .sizing import Measure, measure

#: Documents of a block, and documents and bytes of text of a chunk at most (a longer text is a chunk of its own).
BLOCK = 64
CHUNK_DOCS, CHUNK_BYTES = 16_384, 16 << 20
_CELLS = 4_000_000      # scores held at once inside a task

_TOKEN = np.isin(np.arange(256), [*range(48, 58), *range(97, 123)])
_PARTS = {"places": "<u2", "tfs": "<u4", "peak_blocks": "<u2", "peak_tfs": "<u4", "peak_lengths": "<u4", "lengths": "<u4"}


def _token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens (runs of two or more letters and digits), none across texts."""
    inside = np.concatenate(([False], _TOKEN[data], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    # A run that goes on into the next text is cut at the border.
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    crossed = np.unique(borders[inside[borders] & inside[borders + 1]])
    if len(crossed):
        starts, ends = np.sort(np.concatenate((starts, crossed))), np.sort(np.concatenate((ends, crossed)))
    long = ends - starts >= 2
    return starts[long], ends[long]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - ends + sizes, sizes)


def _cut_points(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array, and its length."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate((np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))), [len(values)]))


def _binary(values: np.ndarray, kind: str, cuts: np.ndarray, before: int = 0, after: int = 0) -> pa.Array:
    """A binary column whose cells are the values between consecutive cuts, with nulls around them."""
    raw = np.ascontiguousarray(values, dtype=kind)
    offsets = (cuts * raw.dtype.itemsize).astype(np.int32)
    cells = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pa.concat_arrays([pa.nulls(before, pa.binary()), cells, pa.nulls(after, pa.binary())])


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all tokens in order, the distinct tokens, and the number of tokens of each text."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64)
    _, offsets, buffer = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, ends = _token_spans(data, offsets)
    sizes = ends - starts
    # A byte for each byte of text tells what is in a token: steps up at starts and down at ends (tokens of two texts may touch).
    steps = np.zeros(len(data) + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    flat = data[np.cumsum(steps[:-1], dtype=np.int8).view(bool)]
    begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(begins), pa.py_buffer(flat)]).dictionary_encode()
    counts = np.diff(np.searchsorted(starts, offsets))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


def pack_chunk(chunk: int, ids: pa.Array, metas: list[pa.Array], codes: np.ndarray, terms: pa.Array, lengths: np.ndarray) -> list[pa.Array]:
    """The rows of a chunk: that of the chunk first, then a row per term in the order of terms."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = pc.sort_indices(terms).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, tfs = np.unique(rank[codes] * len(lengths) + owner, return_counts=True) if len(codes) else (np.zeros(0, np.int64),) * 2
    return _rows(chunk, ids, metas, lengths, terms.take(pa.array(order)), keys // max(len(lengths), 1), keys % max(len(lengths), 1), tfs)


def _rows(chunk: int, ids: pa.Array, metas: list[pa.Array], lengths: np.ndarray, terms: pa.Array, row: np.ndarray, places: np.ndarray, tfs: np.ndarray) -> list[pa.Array]:
    """Columns from postings sorted by (row, place); ``terms`` has the term of every row."""
    cuts = _cut_points(row)
    block = row * (1 << 16) + places // BLOCK
    by = np.lexsort((-tfs, lengths[places], block))
    level = block[by] * (np.int64(tfs.max(initial=0)) + 1) + tfs[by]
    peak = by[np.concatenate(([True], level[1:] > np.maximum.accumulate(level)[:-1]))] if len(by) else by
    peak_cuts = np.searchsorted(row[peak], np.arange(len(terms) + 1))
    n = len(terms)
    one = lambda cell, kind: pa.concat_arrays([pa.array([cell], kind), pa.nulls(n, kind)])
    return [
        pa.array(np.full(n + 1, chunk)), pa.concat_arrays([pa.nulls(1, pa.string()), terms.cast(pa.string())]),
        pa.array(np.concatenate(([len(lengths)], np.diff(cuts) if n else [])).astype(np.int32)), one(int(lengths.sum()), pa.int64()),
        _binary(places, _PARTS["places"], cuts if n else np.zeros(1, np.int64), 1), _binary(tfs, _PARTS["tfs"], cuts if n else np.zeros(1, np.int64), 1),
        _binary(places[peak] // BLOCK, _PARTS["peak_blocks"], peak_cuts, 1), _binary(tfs[peak], _PARTS["peak_tfs"], peak_cuts, 1),
        _binary(lengths[places[peak]], _PARTS["peak_lengths"], peak_cuts, 1), _binary(lengths, _PARTS["lengths"], np.array([0, len(lengths)]), 0, n),
        one(ids.to_pylist(), pa.list_(ids.type)), *(one(m.to_pylist(), pa.list_(pa.string())) for m in metas),
    ]


_NAMES = ["chunk", "term", "n", "length", "places", "tfs", "peak_blocks", "peak_tfs", "peak_lengths", "lengths", "ids"]


def packed_postings(docs: DataFrame) -> DataFrame:
    """Chunks and their posting rows, in one pass over ``doc_id, text`` and the ``meta_`` columns, without a shuffle.

    Null texts have no tokens; documents without tokens take a place all the same.
    """
    metas = [c for c in docs.columns if c.startswith("meta_")]
    names = [*_NAMES, *metas]
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("length", T.LongType()),
        *[T.StructField(c, T.BinaryType()) for c in _NAMES[4:10]], T.StructField("ids", T.ArrayType(id_type)),
        *[T.StructField(c, T.ArrayType(T.StringType())) for c in metas],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The number of the task in the upper half, so chunks of all tasks differ.
        chunk = TaskContext.get().partitionId() << 32
        held, docs, size = [], 0, 0
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(lengths[at:at + CHUNK_DOCS - docs]), CHUNK_BYTES - size, side="right")
                take = int(room) if held or room else 1
                if take:
                    held.append(batch.slice(at, take))
                    docs, size, at = docs + take, size + int(lengths[at:at + take].sum()), at + take
                if at < batch.num_rows or docs == CHUNK_DOCS:
                    yield packed(chunk, held)
                    chunk, held, docs, size = chunk + 1, [], 0, 0
        if held:
            yield packed(chunk, held)

    def packed(chunk: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, texts, *metas = (c.chunk(0) if c.num_chunks else c.combine_chunks() for c in table.columns)
        return pa.RecordBatch.from_arrays(pack_chunk(chunk, ids, metas, *_tokens(texts)), names=names)

    lowered = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), *[F.col(c).cast("string").alias(c) for c in metas])
    return lowered.mapInArrow(run, schema)


def merge_chunks(rows: pa.Table, heads: pa.Table, chunk: int, metas: list[str]) -> pa.Table:
    """Posting rows and chunk rows of several chunks, both with ``turn`` (their order), as the rows of one."""
    heads = heads.sort_by("turn")
    lengths = _flat(heads["lengths"], _PARTS["lengths"])[0].astype(np.int64)
    coded = rows["term"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = rows["n"].to_numpy().astype(np.int64)
    row = np.repeat(rank[coded.indices.to_numpy(zero_copy_only=False)], n) if rows.num_rows else np.zeros(0, np.int64)
    # Documents of the chunks before that of each row.
    before = np.cumsum([0, *heads["n"].to_pylist()])[np.searchsorted(heads["turn"].to_numpy(), rows["turn"].to_numpy())]
    places = _flat(rows["places"], _PARTS["places"])[0].astype(np.int64) + np.repeat(before, n)
    tfs = _flat(rows["tfs"], _PARTS["tfs"])[0].astype(np.int64)
    by = np.argsort(row * (1 << 16) + places, kind="stable")
    flat = lambda c: heads[c].combine_chunks().flatten()
    columns = _rows(chunk, flat("ids"), [flat(m) for m in metas], lengths, coded.dictionary.take(pa.array(order)), row[by], places[by], tfs[by])
    return pa.Table.from_arrays(columns, names=[*_NAMES, *metas])


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------

def _pack_weights(table: pa.Table) -> pa.Table:
    """A block of questions as one row: their ids, and for every term the questions that ask for it with their weights."""
    table = table.group_by(["query_id", "term"]).aggregate([("weight", "sum"), ("q_block", "min")])
    table = table.sort_by([("query_id", "ascending"), ("term", "ascending")])
    asked = table["query_id"].combine_chunks().dictionary_encode()
    coded = table["term"].combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    by = np.argsort(codes, kind="stable")
    number, weight = asked.indices.to_numpy()[by], table["weight_sum"].to_numpy()[by]
    first = np.searchsorted(codes[by], np.arange(len(coded.dictionary) + 1))
    return pa.table({
        "q_block": table["q_block_min"][:1], "query_ids": pa.array([asked.dictionary.to_pylist()], pa.list_(asked.dictionary.type)),
        "terms": pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), "first": [first.astype("<i8").tobytes()],
        "number": [number.astype("<i8").tobytes()], "weight": [weight.astype("<f8").tobytes()],
    })


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and the number of values of each row."""
    cells = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.binary_length(cells).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(cells.to_pylist()), kind), sizes


# What a chunk holds of the asked terms, as arrays.
_HELD = {
    "codes": "<i4", "sizes": "<i4", "places": "<u2", "tfs": "<u4", "peak_sizes": "<i4", "peak_blocks": "<u2", "peak_tfs": "<u4",
    "peak_lengths": "<u4", "lengths": "<u4", "allowed": "?",
}


class _Chunk:
    """The postings of a chunk for a block of questions."""

    def __init__(self, held: dict[str, np.ndarray], asked: dict, cfg: LexicalConfig, avgdl: float):
        self.held, self.cfg, self.avgdl = held, cfg, avgdl
        self.lengths = held["lengths"]
        self.blocks, self.questions = -(-len(self.lengths) // BLOCK), len(asked["query_ids"])
        first, codes = np.frombuffer(asked["first"], "<i8"), held["codes"].astype(np.int64)
        # An entry per row and question that asks for its term.
        asking = first[codes + 1] - first[codes]
        entry = _ranges(first[codes], asking)
        self.row = np.repeat(np.arange(len(codes)), asking)
        self.number, self.weight = np.frombuffer(asked["number"], "<i8")[entry], np.frombuffer(asked["weight"], "<f8")[entry]

    def saturation(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.float64)
        return tf * (self.cfg.k1 + 1) / (tf + self.cfg.k1 * (1 - self.cfg.b + self.cfg.b * length / self.avgdl))

    def bounds(self) -> np.ndarray:
        """questions x blocks: no document of the block scores more."""
        bound = np.zeros(self.questions * self.blocks)
        blocks = self.held["peak_blocks"]
        peaks = self.saturation(self.held["peak_tfs"], self.held["peak_lengths"])
        if not len(blocks):
            return bound.reshape(self.questions, self.blocks)
        of_row = np.repeat(np.arange(len(self.held["codes"])), self.held["peak_sizes"])
        cuts = _cut_points(of_row * (1 << 16) + blocks)[:-1]
        most, blocks = np.maximum.reduceat(peaks, cuts), blocks[cuts].astype(np.int64)
        begins = np.searchsorted(of_row[cuts], np.arange(len(self.held["codes"]) + 1))
        # Entries in slabs of bounded size, each with the blocks of its row.
        sizes = np.diff(begins)[self.row]
        ends, slab = np.cumsum(sizes), 0
        while slab < len(sizes):
            to = max(slab + 1, int(np.searchsorted(ends, (ends[slab - 1] if slab else 0) + _CELLS, side="right")))
            of = _ranges(begins[self.row[slab:to]], sizes[slab:to])
            at = np.repeat(self.number[slab:to] * self.blocks, sizes[slab:to]) + blocks[of]
            bound += np.bincount(at, np.repeat(self.weight[slab:to], sizes[slab:to]) * most[of], len(bound))
            slab = to
        return bound.reshape(self.questions, self.blocks)

    def scores(self, opened: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Questions that open a block, each with the scores of all places; those of closed blocks are 0."""
        places = self.held["places"].astype(np.int64)
        saturation = self.saturation(self.held["tfs"], self.lengths[places])
        block = places // BLOCK
        begins = np.concatenate(([0], np.cumsum(self.held["sizes"], dtype=np.int64))).tolist()
        by = np.argsort(self.number, kind="stable")
        first = np.searchsorted(self.number[by], np.arange(self.questions + 1))
        row, weight = self.row[by].tolist(), self.weight[by].tolist()
        for q in np.flatnonzero(opened.any(1)).tolist():
            score, wanted = np.zeros(len(self.lengths)), opened[q]
            few = 2 * wanted.sum() < len(wanted)
            for n in range(first[q], first[q + 1]):
                part = slice(begins[row[n]], begins[row[n] + 1])
                if few:
                    part = begins[row[n]] + np.flatnonzero(wanted[block[part]])
                score[places[part]] += weight[n] * saturation[part]
            if not wanted.all():
                score[~np.repeat(wanted, BLOCK)[:len(score)]] = 0
            yield q, score

    def best(self, opened: np.ndarray, ids: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question, place and score of the k best documents of opened blocks, best first, ties to the smaller id."""
        allowed = self.held["allowed"]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for q, score in self.scores(opened):
            score = np.round(score, decimals) + 0.0
            if len(allowed):
                score[~allowed] = 0
            at = np.flatnonzero(score > 0)
            if len(at) > k:
                at = at[score[at] >= np.partition(score[at], len(at) - k)[-k]]
            at = at[np.lexsort((ids[at], -score[at]))[:k]]
            found.append((np.full(len(at), q), at, score[at]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _allowed(head: dict, where: dict[str, object]) -> np.ndarray:
    """Which documents of a chunk have all wanted metadata values; empty without a filter."""
    kept = np.ones(head["n"] if where else 0, bool)
    for name, value in where.items():
        text = str(value).lower() if isinstance(value, bool) else str(value)
        kept &= np.array([v == text for v in head[f"meta_{name}"]], bool)
    return kept


def _gathered(rows: pa.Table, head: dict, where: dict[str, object]) -> dict[str, np.ndarray]:
    """The posting rows of a chunk as flat arrays."""
    held = {}
    for name in ("places", "tfs", "peak_blocks", "peak_tfs", "peak_lengths"):
        held[name], sizes = _flat(rows[name], _PARTS[name])
        if name in ("places", "peak_blocks"):
            held["sizes" if name == "places" else "peak_sizes"] = sizes
    codes = pc.index_in(rows["term"], value_set=pa.array(head["terms"], pa.string()))
    return held | {"codes": codes.to_numpy(), "lengths": np.frombuffer(head["lengths"], _PARTS["lengths"]), "allowed": _allowed(head, where)}


def _first_round(rows: pa.Table, heads: pa.Table, *, k: int, cfg: LexicalConfig, avgdl: float, decimals: int, where: dict[str, object], schema: pa.Schema) -> pa.Table:
    """A chunk for a block of questions: its postings, the bound of each question, and what their best blocks hold."""
    if not heads.num_rows or not rows.num_rows:
        return schema.empty_table()
    head = heads.slice(0, 1).to_pylist()[0]
    held = _gathered(rows, head, where)
    chunk = _Chunk(held, head, cfg, avgdl)
    bound = chunk.bounds()
    opened = np.zeros(bound.shape, bool)
    opened[np.arange(len(bound)), bound.argmax(1)] = True
    number, _, score = chunk.best(opened & (bound > 0), np.arange(len(chunk.lengths)), k, decimals)
    scored = pa.array([{"number": n, "score": x} for n, x in zip(number.tolist(), score.tolist())], schema.field("scores").type.value_type)
    return pa.table({
        "q_block": [head["q_block"]], "ids": pa.array([head["ids"]], schema.field("ids").type), "bound": [bound.max(1).tolist()],
        "scores": pa.ListArray.from_arrays(pa.array([0, len(scored)], pa.int32()), scored),
        **{name: [np.ascontiguousarray(held[name], dtype=kind).tobytes()] for name, kind in _HELD.items()},
    }).cast(schema)


def _reached(row: dict, cfg: LexicalConfig, avgdl: float, decimals: int) -> tuple[_Chunk | None, np.ndarray, int]:
    """The chunk of a row of the first round, the blocks that can reach the thresholds, and how many hold an asked term."""
    least = np.array(row["least"], np.float64)[:, None] - 2 * 10.0**-decimals  # scores are rounded, bounds are not
    if not (np.array(row["bound"])[:, None] >= least).any():
        return None, np.zeros((0, 0), bool), 0
    chunk = _Chunk({name: np.frombuffer(row[name], kind) for name, kind in _HELD.items()}, row, cfg, avgdl)
    bound = chunk.bounds()
    return chunk, (bound > 0) & (bound >= least), int((bound > 0).sum())


_GROUP = ("batch", "chunk", "q_block")


class BlockSearch:
    """A search over packed postings: thresholds from the best blocks, then the blocks that can reach them."""

    def __init__(
        self, posting: Callable[[DataFrame, bool], DataFrame], chunks: DataFrame, queries: DataFrame, terms: DataFrame, corpus: Corpus, k: int, *,
        cfg: LexicalConfig = LexicalConfig(), decimals: int = RetrievalConfig.decimals, limits: SizeLimits = SizeLimits(),
        where: dict[str, object] | None = None,
    ):
        """``posting(terms, few)`` gives the posting rows of a table of terms; ``chunks`` are the rows of chunks, both with ``batch``."""
        where = where or {}
        for name in where:
            if f"meta_{name}" not in chunks.columns:
                raise ValueError(f"no column for filter key {name!r}")
        self.k, self.query_type, self.id_type = k, queries.schema["query_id"].dataType, chunks.schema["ids"].dataType.elementType
        self.options = {"cfg": cfg, "avgdl": corpus.avgdl or 1.0, "decimals": decimals}
        # A bound from the texts alone: a token takes three of their bytes and less than a hundred in a row.
        size = measure(queries.select("query_id", "text"))
        size = Measure(size.rows, 32 * size.bytes)
        few = size.bytes <= limits.broadcast_bytes
        blocks = 1 if few else size.blocks(limits.broadcast_bytes)
        asked = queries.select("query_id", F.explode(tokens("text")).alias("term"))
        known = terms.select("term", "df").join(F.broadcast(asked) if few else asked, "term").select(
            "query_id", "term", idf(F.col("df"), corpus, cfg).alias("weight"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q_block"))
        self.packed = materialise(known.groupBy("q_block").applyInArrow(
            _pack_weights, f"q_block int, query_ids array<{self.query_type.simpleString()}>, terms array<string>, first binary, number binary, weight binary"), "weights")
        wanted = self.packed.select("q_block", F.explode("terms").alias("term"))
        if few:
            rows = posting(wanted.select("term"), True).withColumn("q_block", F.lit(0))
        else:
            rows = posting(wanted.select("term").distinct(), False).join(wanted, "term")
        # Both may come from one table: aliases keep their columns apart.
        heads = chunks.select(*[F.col(c).alias(c) for c in ("batch", "chunk", "n", "lengths", "ids", *(f"meta_{name}" for name in where))])
        heads = heads.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        self.few, self.where = few, where
        self.first = self._first(rows, heads.join(self._sent(self.packed), "q_block"))

    def _sent(self, packed: DataFrame) -> DataFrame:
        return F.broadcast(packed) if self.few else packed

    def _first(self, rows: DataFrame, heads: DataFrame) -> DataFrame:
        schema = T.StructType([
            T.StructField("q_block", T.IntegerType()), T.StructField("ids", T.ArrayType(self.id_type)), T.StructField("bound", T.ArrayType(T.DoubleType())),
            T.StructField("scores", T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
            *[T.StructField(name, T.BinaryType()) for name in _HELD],
        ])
        arrow = pa.schema([
            ("q_block", pa.int32()), ("ids", pa.list_(_arrow(self.id_type))), ("bound", pa.list_(pa.float64())),
            ("scores", pa.list_(pa.struct([("number", pa.int32()), ("score", pa.float64())]))), *((name, pa.binary()) for name in _HELD)])
        run = partial(_first_round, k=self.k, where=self.where, schema=arrow, **self.options)
        # A number of partitions that adaptive execution keeps: chunks are few bytes and much work.
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.select(*_GROUP, "term", "places", "tfs", "peak_blocks", "peak_tfs", "peak_lengths")
        left, right = (x.repartition(parts, *_GROUP).groupBy(*_GROUP) for x in (rows, heads))
        return materialise(left.cogroup(right).applyInArrow(lambda a, b: run(a, b), schema), "first-round")

    def reaching(self) -> DataFrame:
        """Rows of the first round with their questions and ``least``: the score that a hit of each question needs."""
        order = Window.partitionBy("q_block", "number").orderBy(F.desc("score"))
        ranked = self.first.select("q_block", F.inline("scores")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == self.k)
        kth = ranked.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("known"))
        numbers = F.sequence(F.lit(0), F.size("query_ids") - 1)
        value = lambda n: F.coalesce(F.try_element_at("known", n), F.lit(0.0))
        packed = self.packed.join(kth, "q_block", "left").withColumn("least", F.transform(numbers, value)).drop("known", "terms")
        return self.first.drop("scores").join(self._sent(packed), "q_block")

    def hits(self) -> DataFrame:
        """``query_id, doc_id, score, rank``."""
        schema = T.StructType([T.StructField("query_id", self.query_type), T.StructField("doc_id", self.id_type), T.StructField("score", T.DoubleType())])
        q_type, d_type, options, k = _arrow(self.query_type), _arrow(self.id_type), self.options, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    row = batch.slice(n, 1).to_pylist()[0]
                    chunk, opened, _ = _reached(row, **options)
                    if chunk is not None:
                        ids = np.array(row["ids"])
                        number, place, score = chunk.best(opened, ids, k, options["decimals"])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(row["query_ids"], q_type).take(pa.array(number)), pa.array(row["ids"], d_type).take(pa.array(place)), pa.array(score),
                        ], names=["query_id", "doc_id", "score"])

        return best_first(self.reaching().mapInArrow(run, schema), self.k)

    def opened(self) -> tuple[int, int]:
        """Blocks that the second round opens and blocks that hold an asked term, of chunks in reach, each counted once a question."""
        options = self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_reached(batch.slice(n, 1).to_pylist()[0], **options) for n in range(batch.num_rows)]
                yield pa.RecordBatch.from_pydict({"opened": [int(f[1].sum()) for f in found], "held": [f[2] for f in found]})

        total = self.reaching().mapInArrow(run, "opened long, held long").agg(F.sum("opened"), F.sum("held")).first()
        return total[0] or 0, total[1] or 0


def _arrow(dtype: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dtype.simpleString()]


def packed_terms(packed: DataFrame) -> DataFrame:
    """``term, df, docs, length`` of packed postings; the null term carries the totals."""
    return packed.groupBy("term").agg(
        F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).cast("long").alias("df"),
        F.sum(F.when(F.col("term").isNull(), F.col("n")).otherwise(0)).cast("long").alias("docs"),
        F.sum(F.coalesce("length", F.lit(0))).cast("long").alias("length"))


def chunk_rows(packed: DataFrame) -> DataFrame:
    return packed.filter(F.col("term").isNull())


def block_search(
    docs: DataFrame, queries: DataFrame, k: int = LexicalConfig.top_k, *, cfg: LexicalConfig = LexicalConfig(),
    decimals: int = RetrievalConfig.decimals, limits: SizeLimits = SizeLimits(), where: dict[str, object] | None = None,
) -> DataFrame:
    """BM25 top-k straight from texts: ``query_id, doc_id, score, rank``.  Texts are read once and packed in the shared folder."""
    packed = materialise(packed_postings(docs).withColumn("batch", F.lit("")), "packed-postings")
    terms = materialise(packed_terms(packed), "terms")
    return BlockSearch(
        lambda wanted, few: packed.join(F.broadcast(wanted) if few else wanted, "term", "left_semi"), chunk_rows(packed), queries, terms, read_corpus(corpus_statistics(terms)), k,
        cfg=cfg, decimals=decimals, limits=limits, where=where).hits()
