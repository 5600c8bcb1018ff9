"""Removal of repeated word windows with a count-min prefilter.

A window is ``size`` consecutive words.  First every chunk of documents sketches
its windows: counters, by a hash, for the cells that occur.  The sketches of all
chunks are merged, a range of cells at a time, so that no task holds more than
``RANGE`` of them; merged counts are never too small.  Only windows whose cell
counts two or more go on to the second pass, which groups them exactly by 128
bits of hash and keeps the earliest.  What comes back to a chunk is one bit for
each of its distinct cells or windows.

A chunk sends a window once however often it occurs there, so a passage that
sits in a third of all documents is as many entries as there are chunks.  Chunks
are written to the shared folder first, so every pass sees the same ones.  Their
texts are compressed until a task works on them: rows, batches and shuffles of
the passes never hold them in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .packed import bits, from_bits, pack, runs, stored, unpack
from .words import Texts, Words, slices, texts_of, windows, word_hashes, words_of

CHUNK_BYTES = 2 << 20
#: Cells or windows that one task merges.
RANGE = 2_000_000
#: Of these it sorts so many at once.
PIECE = 250_000
#: Replies up to so many bytes go to all tasks; beyond it they are shuffled with the chunks.
BROADCAST_BYTES = 64 << 20

_LAST = np.iinfo(np.int64).max


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, packed, windows): ids and texts of documents in chunks, each sorted by id; null ids come last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece, _ in slices(batch, "text", CHUNK_BYTES):
                order = np.argsort(piece.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False), kind="stable")
                piece = piece.take(pa.array(order))
                n = int(np.maximum(words_of(texts_of(piece.column(1))).counts - size + 1, 0).sum())
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_packed(piece)], pa.binary()), pa.array([n])], names=["chunk", "packed", "windows"])
                number += 1

    return docs.mapInArrow(run, "chunk long, packed binary, windows long")


def _packed(piece: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as writer:
        writer.write_batch(piece)
    return out.getvalue().to_pybytes()


class _Chunk:
    """The documents of one row, their words and windows."""

    def __init__(self, batch: pa.RecordBatch, row: int, size: int, width: int):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        self.number, self.size, self.width = get("chunk")[row].as_py(), size, width
        piece = pa.ipc.open_stream(get("packed")[row].as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()
        self.ids = piece.column(0)
        self.texts: Texts = texts_of(piece.column(1))
        self.words: Words = words_of(self.texts)
        self.first, self.second, self.at = windows(word_hashes(self.texts, self.words), self.words, size)
        self.replies = {n: sorted((x["place"], x["bits"]) for x in get(n)[row].as_py() or ()) if n in batch.schema.names else [] for n in ("cells_reply", "windows_reply")}

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(self.first >> np.uint64(64 - 8 * self.width), return_inverse=True, return_counts=True)

    def suspects(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose cell counts two or more, sorted so that equal ones adjoin, earliest first; where each group begins."""
        cells, at, counts = self.cells()
        often = counts > 1
        done = 0
        for place, reply in self.replies["cells_reply"]:
            n = int(np.searchsorted(cells, _edge(place + 1, self.ranges, self.width)) if place + 1 < self.ranges else len(cells)) - done
            often[done:done + n] |= from_bits(reply, n)
            done += n
        rows = np.flatnonzero(often[at])
        rows = rows[np.lexsort((self.second[rows], self.first[rows]))]
        return rows, runs(self.first[rows], self.second[rows])


def _edge(place: int, ranges: int, width: int) -> np.uint64:
    """The smallest value of ``width`` bytes in a range."""
    return np.uint64((place << (8 * width)) // ranges)


def _slots(values: np.ndarray, ranges: int, width: int) -> np.ndarray:
    """Bounds of the ranges in sorted values."""
    inner = np.searchsorted(values, np.array([_edge(p, ranges, width) for p in range(1, ranges)], np.uint64))
    return np.concatenate(([0], inner, [len(values)])).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], size: int, width: int, ranges: int) -> Iterator[_Chunk]:
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = _Chunk(batch, row, size, width)
            chunk.ranges = ranges
            yield chunk


def _pieces(parts: list[np.ndarray]) -> Iterator[list[slice]]:
    """Sorted arrays cut at the same values, about ``PIECE`` of them all at a time; equal ones stay together."""
    filled = [p for p in parts if len(p)]
    n = ceil(sum(map(len, filled)) / PIECE)
    if not n:
        return
    low, high = min(int(p[0]) for p in filled), max(int(p[-1]) for p in filled)
    edges = np.array([low + (high - low) * k // n for k in range(1, n)], np.uint64)
    bounds = np.array([np.concatenate(([0], np.searchsorted(p, edges), [len(p)])) for p in parts])
    for k in range(n):
        yield [slice(a, b) for a, b in bounds[:, k:k + 2].tolist()]


def _replies(table: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({"chunk": table["chunk"], "place": table["place"], "bits": pa.array([bits(f) for f in flags], pa.binary())})


def _deal(found: np.ndarray, at: list[slice], flags: list[np.ndarray]) -> None:
    """Put the flags of a piece where they belong."""
    done = 0
    for where, own in zip(at, flags):
        n = where.stop - where.start
        own[where] = found[done:done + n]
        done += n


def _merge_cells(width: int):
    """Merge the sketches of a range: which cells of each chunk occur in another one too."""
    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_buffer(), width) for x in table["cells"]]
        replies = [np.zeros(len(p), bool) for p in parts]
        for at in _pieces(parts):
            cells = np.concatenate([p[w] for p, w in zip(parts, at)])
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            same = cells[1:] == cells[:-1]
            often = np.zeros(len(cells), bool)
            often[order[1:][same]] = True
            often[order[:-1][same]] = True
            _deal(often, at, replies)
        return _replies(table, replies)
    return run


def _merge_windows(table: pa.Table) -> pa.Table:
    """Group the suspected windows of a range exactly: which of each chunk also start in an earlier document."""
    held = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
    keys, owners, known = [x.reshape(-1, 2) for x in held("keys", np.uint64)], held("owners", np.uint32), held("ids", np.int64)
    numbers = table["chunk"].to_numpy()
    replies = [np.zeros(len(x), bool) for x in keys]
    for at in _pieces([x[:, 0] for x in keys]):
        first, second = np.concatenate([x[w] for x, w in zip(keys, at)]).T
        ids = np.concatenate([x[o[w]] for x, o, w in zip(known, owners, at)])
        chunks = np.repeat(numbers, [w.stop - w.start for w in at])
        order = np.lexsort((chunks, ids, second, first))
        later = np.ones(len(order), bool)
        later[order[runs(first[order], second[order])]] = False
        _deal(later, at, replies)
    return _replies(table, replies)


_REPLY = "chunk long, place int, bits binary"


def _answered(chunks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """``chunks`` with the replies to each as an array column."""
    replies = stored(replies, name)
    size = replies.agg(F.coalesce(F.sum(F.octet_length("bits") + 64), F.lit(0))).first()[0]
    listed = replies.groupBy("chunk").agg(F.collect_list(F.struct("place", "bits")).alias(name))
    return chunks.join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed, "chunk", "left")


def drop_repeats(docs: DataFrame, size: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the words of windows that also start earlier.

    Returns the id, n_words, n_removed and ``kept``, the other words joined by
    one space.  A word goes if a window that covers it also starts in a document
    of smaller id, or earlier in the same one; windows are judged on the input.
    A null or empty text has no words.  Every row of ``docs`` gives one; rows of
    equal id are judged like documents in the order they were read, null ids
    like the largest.  Other columns are left out.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    chunks = stored(chunked(docs, size), "chunks")
    total = chunks.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    ranges = ceil(total / RANGE) or 1
    width = min(8, max(5, ceil((log2(max(total, 1)) + 12) / 8)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size, width, ranges):
            cells, _, _ = chunk.cells()
            bounds = _slots(cells, ranges, width)
            there = np.arange(ranges)
            packed = [pack(cells[bounds[p]:bounds[p + 1]], width) for p in there]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(ranges, chunk.number)), pa.array(there, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "place", "cells"])

    cells = chunks.select("chunk", "packed").mapInArrow(sketch, "chunk long, place int, cells binary")
    replies = cells.repartition(ranges, "place").groupBy("place").applyInArrow(_merge_cells(width), _REPLY)
    chunks = _answered(chunks.select("chunk", "packed"), replies, "cells_reply")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size, width, ranges):
            rows, begin = chunk.suspects()
            rows = rows[begin]
            owner = np.searchsorted(chunk.words.first, chunk.at[rows], side="right") - 1
            ids = chunk.ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
            bounds = _slots(chunk.first[rows], ranges, 8)
            for p in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[p], bounds[p + 1])
                known, short = np.unique(owner[part], return_inverse=True)
                keys = np.column_stack((chunk.first[rows[part]], chunk.second[rows[part]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.number]), pa.array([p], pa.int32()), pa.array([keys.tobytes()]), pa.array([short.astype(np.uint32).tobytes()]), pa.array([ids[known].tobytes()])],
                    names=["chunk", "place", "keys", "owners", "ids"])

    found = chunks.mapInArrow(suspects, "chunk long, place int, keys binary, owners binary, ids binary")
    replies = found.repartition(ranges, "place").groupBy("place").applyInArrow(_merge_windows, _REPLY)
    chunks = _answered(chunks, replies, "windows_reply")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size, width, ranges):
            rows, begin = chunk.suspects()
            gone = np.ones(len(rows), bool)
            gone[begin] = False
            bounds = _slots(chunk.first[rows[begin]], ranges, 8)
            for place, reply in chunk.replies["windows_reply"]:
                gone[begin[bounds[place]:bounds[place + 1]]] = from_bits(reply, bounds[place + 1] - bounds[place])
            cover = np.zeros(len(chunk.words.starts) + 1, np.int64)
            np.add.at(cover, chunk.at[rows[gone]], 1)
            np.add.at(cover, chunk.at[rows[gone]] + size, -1)
            keep = np.cumsum(cover)[:-1] == 0
            yield _kept(chunk, keep, doc_id)

    schema = T.StructType([T.StructField(doc_id, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return chunks.mapInArrow(cleaned, schema)


def _kept(chunk: _Chunk, keep: np.ndarray, doc_id: str) -> pa.RecordBatch:
    """The words to keep of each text, with one space between."""
    words, data = chunk.words, chunk.texts.data
    starts, ends = words.starts[keep], words.ends[keep]
    total = np.concatenate(([0], np.cumsum(keep)))
    first = total[words.first]
    # Each word takes the byte behind it, which becomes the space; the last of a text goes without.
    padded = np.append(data, np.uint8(32))
    joined, at = _spans(padded, starts, ends + 1)
    if len(starts):
        joined[at[1:] - 1] = 32
    last = np.zeros(len(joined), bool)
    filled = np.flatnonzero(np.diff(first))
    last[at[first[filled + 1]] - 1] = True
    before = np.concatenate(([0], np.cumsum(last)))
    bounds = at[first]
    text = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer((bounds - before[bounds]).astype(np.int64).tobytes()), pa.py_buffer(joined[~last].tobytes()))
    counts, left = words.counts, np.diff(first)
    return pa.RecordBatch.from_arrays([chunk.ids, pa.array(counts), pa.array(counts - left), text.cast(pa.string())], names=[doc_id, "n_words", "n_removed", "kept"])


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    return data[np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)], at


def digests(docs: DataFrame) -> DataFrame:
    done = drop_repeats(docs)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
