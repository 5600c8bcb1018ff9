"""Ranked lexical search with Block-Max MaxScore over shards of documents.

A shard is an index of a few megabytes of whole texts: for every term a list of
(document, frequency), cut into compressed blocks of ``BLOCK`` postings.  Beside
each block lie its last document and the (frequency, length) pairs that no other
pair of the block beats, so the largest contribution of the block follows for
any corpus totals.  Shards are made where the texts are read; no posting is
shuffled, and a term in every document is as evenly spread as the documents.

A search orders a query's lists by their bounds.  The lists whose bounds sum up
to less than the k-th score so far are non-essential: a document in none of the
others cannot be a hit.  Essential lists give the candidates; block maxima of the
non-essential ones reject candidates before a block is decompressed.  The k best
so far go from shard to shard of a task, and the heaps of all tasks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.sizing import broadcast_if_small
from ..session import materialise
from .packed import stored
from .words import slices, span_hashes, words_of

#: Bytes of text in a shard, postings in a block, documents scored at once.
SHARD_BYTES = 8 << 20
BLOCK = 64
WINDOW = 4096
#: Rows of asked terms up to which only their postings are indexed, and bytes of queries up to which they go to every task.
ASKED_TERMS = 4 << 20
BROADCAST_BYTES = 32 << 20
QUERY_BLOCK = 4096
#: Shards that a task of a search goes through, one after another with the k best so far.
TASK_SHARDS = 4

_TERM_BREAK = np.ones(256, bool)
_TERM_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_FIELDS = {
    "ids": np.int64, "lengths": np.uint32, "terms": np.uint64, "first_block": np.uint32, "counts": np.uint32, "last": np.uint32,
    "kind": np.uint8, "at": np.uint32, "first_peak": np.uint32, "peak_tf": np.uint32, "peak_length": np.uint32, "data": np.uint8,
}
_SHARD = "n_docs long, n_terms long, known int, " + ", ".join(f"{name} binary" for name in _FIELDS)
_WIDTHS = (1, 2, 4)


def term_hashes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of every term, and the number of terms of each text."""
    lowered = texts.lowered()
    words = words_of(lowered, _TERM_BREAK)
    return span_hashes(lowered.data, words.starts, words.ends), words.text_of(), words.counts


def _width(most: np.ndarray) -> np.ndarray:
    return (most > 255).astype(np.int64) + (most > 65535)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every (start, size), one after another."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def pack_shard(ids: np.ndarray, known: int, lengths: np.ndarray, terms: np.ndarray, docs: np.ndarray, tfs: np.ndarray) -> dict[str, object]:
    """A shard of documents in the order of their ids, from postings in the order of (term, document)."""
    begins = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(terms)))
    blocks = -(-counts // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    within = np.arange(len(terms)) - np.repeat(begins, counts)
    block = np.repeat(first_block[:-1], counts) + within // BLOCK
    start = np.flatnonzero(within % BLOCK == 0)
    sizes = np.diff(np.append(start, len(terms)))
    gap = docs.astype(np.int64).copy()
    gap[1:] -= np.where(within[1:] % BLOCK == 0, 0, docs[:-1])
    most_gap, most_tf = (np.maximum.reduceat(x, start) if len(start) else np.zeros(0, np.int64) for x in (gap, tfs))
    kind = _width(most_gap) * 3 + _width(most_tf)
    widths = np.array(_WIDTHS)
    gap_width, tf_width = widths[kind // 3], widths[kind % 3]
    size = sizes * (gap_width + tf_width)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    inside = within % BLOCK
    for values, width, begin in ((gap, gap_width, at), (tfs, tf_width, at + sizes * gap_width)):
        w = width[block]
        place = begin[block] + inside * w
        for byte in range(4):
            has = w > byte
            data[place[has] + byte] = (values[has] >> (8 * byte)) & 255
    # Pairs that no pair of the same block beats: by length, each with a higher frequency than all before.
    order = np.lexsort((-tfs, lengths[docs], block))
    top = np.int64(tfs.max(initial=0)) + 1
    level = block[order] * top + tfs[order]
    beats = np.concatenate(([True], level[1:] > np.maximum.accumulate(level)[:-1])) if len(level) else np.zeros(0, bool)
    peak = order[beats]
    return {
        "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "known": known,
        "ids": ids, "lengths": lengths, "terms": terms[begins], "first_block": first_block, "counts": counts,
        "last": docs[np.append(start[1:], len(terms)) - 1] if len(terms) else docs, "kind": kind, "at": at,
        "first_peak": np.searchsorted(block[peak], np.arange(len(start) + 1)), "peak_tf": tfs[peak], "peak_length": lengths[docs[peak]], "data": data,
    }


class _Builder:
    """Collects slices of texts until they make a shard."""

    def __init__(self, asked: np.ndarray | None):
        self.asked, self.parts, self.size, self.docs = asked, [], 0, 0

    def add(self, ids: pa.Array, texts) -> None:
        hashes, owner, lengths = term_hashes(texts)
        if self.asked is not None and len(self.asked):
            at = np.minimum(np.searchsorted(self.asked, hashes), len(self.asked) - 1)
            wanted = self.asked[at] == hashes
            hashes, owner = hashes[wanted], owner[wanted]
        elif self.asked is not None:
            hashes, owner = hashes[:0], owner[:0]
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))) if len(hashes) else np.zeros(0, np.int64)
        self.parts.append((ids, lengths, hashes[new], owner[new] + self.docs, np.diff(np.append(new, len(hashes)))))
        self.size, self.docs = self.size + int(texts.offsets[-1]), self.docs + len(ids)

    def take(self) -> pa.RecordBatch:
        ids = pa.chunked_array([p[0] for p in self.parts]).combine_chunks()
        lengths, terms, docs, tfs = (np.concatenate([p[n] for p in self.parts]) for n in (1, 2, 3, 4))
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((numbers, missing))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        docs = rank[docs]
        by = np.lexsort((docs, terms))
        shard = pack_shard(numbers[order], int((~missing).sum()), lengths[order], terms[by], docs[by], tfs[by].astype(np.int64))
        self.parts, self.size, self.docs = [], 0, 0
        row = {n: [np.ascontiguousarray(v, dtype=_FIELDS[n]).tobytes()] if n in _FIELDS else [v] for n, v in shard.items()}
        kinds = {"n_docs": pa.int64(), "n_terms": pa.int64(), "known": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.binary())) for n, v in row.items()], names=list(row))


@dataclass
class Index:
    """Stored shards, the document frequency of every term (by hash), and the corpus totals."""

    shards: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int
    n_shards: int


def query_terms(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times) of a table of queries; a null text has no terms.  Rows of one id make up one query."""
    at = items.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch):
                hashes, owner, _ = term_hashes(texts)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(owner)), pa.array(hashes.view(np.int64))], names=["item_id", "term"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, f"item_id {at.dataType.simpleString()}, term long")
    return materialise(found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "query-terms")


def build(docs: DataFrame, asked: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> Index:
    """Index whole texts; with ``asked`` (term) only the postings of those terms, while they are few enough to send to every task.

    A null text has no terms; documents without terms count nowhere.  Rows of
    one id are documents of their own.
    """
    shared = None
    if asked is not None:
        terms = asked.select("term").distinct()
        if terms.count() <= ASKED_TERMS:
            hashes = np.sort(terms.toArrow().column("term").combine_chunks().to_numpy().view(np.uint64))
            shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _Builder(None if shared is None else shared.value)
        for batch in batches:
            for piece, texts in slices(batch):
                builder.add(piece.column(0), texts)
                if builder.size >= SHARD_BYTES:
                    yield builder.take()
        if builder.parts:
            yield builder.take()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(counts, np.uint32).astype(np.int64))], names=["term", "df"])

    shards = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _SHARD), "shards")
    totals = shards.agg(F.sum("n_docs"), F.sum("n_terms"), F.count(F.lit(1))).first()
    counted = shards.select("terms", "counts").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(shards, materialise(counted, "frequencies"), int(totals[0] or 0), int(totals[1] or 0), totals[2])


class Shard:
    """An opened shard: bounds from its block maxima, and blocks that are decompressed when asked for."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        for name, kind in _FIELDS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.known = row["known"]
        self.last, self.first_block, self.at = (x.astype(np.int64) for x in (self.last, self.first_block, self.at))
        # Blocks are full but for the last of each list.
        counts = self.counts.astype(np.int64)
        n_blocks = np.diff(self.first_block)
        self.sizes = np.full(len(self.last), BLOCK)
        self.sizes[self.first_block[1:] - 1] = counts - (n_blocks - 1) * BLOCK
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))
        distinct, inverse = np.unique(self.lengths, return_inverse=True)
        self.norm = np.array([25 + 75 * int(n) * n_docs // max(n_terms, 1) for n in distinct], np.int64)[inverse] if len(distinct) else np.zeros(0, np.int64)
        norms = dict(zip(distinct.tolist(), range(len(distinct))))
        peak_norm = np.array([25 + 75 * n * n_docs // max(n_terms, 1) for n in distinct.tolist()], np.int64)[[norms[n] for n in self.peak_length.tolist()]] if len(self.peak_length) else np.zeros(0, np.int64)
        peaks = _impact(self.peak_tf.astype(np.int64), peak_norm)
        self.most = np.maximum.reduceat(peaks, self.first_peak[:-1].astype(np.int64)) if len(peaks) else np.zeros(0, np.int64)
        self.list_most = np.maximum.reduceat(self.most, self.first_block[:-1]) if len(self.most) else self.most
        self.open = np.zeros(len(self.last), bool)
        self.docs, self.impacts = np.zeros(self.begin[-1], np.int64), np.zeros(self.begin[-1], np.int64)

    def unpack(self, blocks: np.ndarray) -> None:
        """Decompress those of ``blocks`` that are not open yet."""
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        self.open[blocks] = True
        for kind in np.unique(self.kind[blocks]):
            some = blocks[self.kind[blocks] == kind]
            gap_width, tf_width = _WIDTHS[kind // 3], _WIDTHS[kind % 3]
            sizes = self.sizes[some]
            to = _spread(self.begin[some], sizes)
            inside = _spread(np.zeros(len(some), np.int64), sizes)
            base = np.repeat(self.at[some], sizes)
            gaps, tfs = np.zeros(len(to), np.int64), np.zeros(len(to), np.int64)
            for byte in range(gap_width):
                gaps |= self.data[base + inside * gap_width + byte].astype(np.int64) << (8 * byte)
            base = base + np.repeat(sizes * gap_width, sizes)
            for byte in range(tf_width):
                tfs |= self.data[base + inside * tf_width + byte].astype(np.int64) << (8 * byte)
            sums = np.cumsum(gaps)
            first = np.cumsum(sizes) - sizes
            docs = sums - np.repeat(sums[first] - gaps[first], sizes)
            self.docs[to], self.impacts[to] = docs, _impact(tfs, self.norm[docs])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Heap) -> None:
        """Offer to ``best`` every document of the shard that can be among its k."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        found = (self.terms[at] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        lists, weights = at[found], weights[found]
        bounds = weights * self.list_most[lists]
        order = np.argsort(bounds, kind="stable")
        lists, weights, bounds = lists[order], weights[order], bounds[order]
        below = np.concatenate(([0], np.cumsum(bounds)))
        for low in range(0, len(self.ids), WINDOW):
            if below[-1] < best.least:
                return
            self._window(low, min(low + WINDOW, len(self.ids)), lists, weights, below, best)

    def _blocks(self, lists: int, low: int) -> int:
        begin, end = self.first_block[lists], self.first_block[lists + 1]
        return begin + np.searchsorted(self.last[begin:end], low)

    def _window(self, low: int, high: int, lists: np.ndarray, weights: np.ndarray, below: np.ndarray, best: Heap) -> None:
        # Non-essential lists: the longest prefix whose bounds sum up to less than a hit needs.
        split = int(np.searchsorted(below, best.least, side="left")) - 1
        scores = np.zeros(high - low, np.int64)
        for n in range(len(lists) - 1, split - 1, -1):
            end = self.first_block[lists[n] + 1]
            begin, stop = self._blocks(lists[n], low), min(self._blocks(lists[n], high - 1) + 1, end)
            if begin >= stop:
                continue
            self.unpack(np.arange(begin, stop))
            part = slice(self.begin[begin], self.begin[stop])
            docs, impacts = self.docs[part], self.impacts[part]
            inside = slice(*np.searchsorted(docs, (low, high)))
            scores[docs[inside] - low] += weights[n] * impacts[inside]
        found = np.flatnonzero(scores)
        found = found[scores[found] + below[split] >= best.least]
        score, found = scores[found], found + low
        if split > 0 and len(found):
            # The block of each non-essential list that would hold a candidate, and the most it adds.
            blocks = np.empty((split, len(found)), np.int64)
            most = np.zeros((split, len(found)), np.int64)
            for n in range(split):
                begin, end = self.first_block[lists[n]], self.first_block[lists[n] + 1]
                blocks[n] = begin + np.searchsorted(self.last[begin:end], found)
                there = blocks[n] < end
                most[n, there] = weights[n] * self.most[blocks[n, there]]
            rest = np.cumsum(most, axis=0)
            for n in range(split - 1, -1, -1):
                keep = score + rest[n] >= best.least
                found, score, blocks, most, rest = found[keep], score[keep], blocks[:, keep], most[:, keep], rest[:, keep]
                asking = np.flatnonzero(most[n])
                if not len(asking):
                    continue
                needed = np.unique(blocks[n, asking])
                self.unpack(needed)
                sizes = self.sizes[needed]
                to = _spread(self.begin[needed], sizes)
                docs = self.docs[to]
                place = np.minimum(np.searchsorted(docs, found[asking]), len(docs) - 1)
                hit = docs[place] == found[asking]
                score[asking[hit]] += weights[n] * self.impacts[to[place[hit]]]
        best.offer(score, self.ids[found], found >= self.known)


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class Heap:
    """The k best (score, id), ties to the smaller id; ``least`` is the score that a further hit needs."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        enough = score >= self.least
        if not enough.any():
            return
        score, ids, missing = (np.concatenate((old, new[enough])) for old, new in ((self.score, score), (self.ids, ids), (self.missing, missing)))
        best = np.lexsort((ids, missing, -score))[:self.k]
        self.score, self.ids, self.missing = score[best], ids[best], missing[best]
        if len(best) == self.k:
            self.least = max(1, int(self.score[-1]))


def _pack_queries(table: pa.Table) -> pa.Table:
    """A block of queries as one row: their numbers, where each begins, terms and weights."""
    table = table.sort_by("number")
    number = table["number"].to_numpy()
    begins = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    return pa.table({
        "q_block": table["q_block"][:1], "numbers": [number[begins].astype(np.int64).tobytes()],
        "starts": [np.append(begins, len(number)).astype(np.int64).tobytes()],
        "q_terms": [table["term"].to_numpy().tobytes()], "q_weights": [table["weight"].to_numpy().tobytes()],
    })


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * df + 1))).cast("long")


def search(index: Index, asked: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of every query of ``asked`` (item_id, term, times): item_id, rank, doc_id, score.

    Only scores above 0 are hits; ties go to the smaller id, null ids come last.
    Queries without known terms have no rows.
    """
    known = asked.join(index.frequencies, "term").select("item_id", "term", (F.col("times") * weight(F.col("df"), index.n_docs)).alias("weight"))
    known = materialise(known.filter("weight > 0"), "weights")
    blocks = max(1, ceil(known.select("item_id").distinct().count() / QUERY_BLOCK))
    items = known.select("item_id").distinct().withColumn("q_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    items = materialise(items.withColumn("number", F.row_number().over(Window.partitionBy("q_block").orderBy("item_id")).cast("long")), "items")
    numbered = known.join(broadcast_if_small(items, BROADCAST_BYTES), known["item_id"].eqNullSafe(items["item_id"])).select("q_block", "number", "term", "weight")
    packed = materialise(numbered.groupBy("q_block").applyInArrow(_pack_queries, "q_block int, numbers binary, starts binary, q_terms binary, q_weights binary"), "queries")
    # A shard is small for a scan and much work for a search, so they are dealt out by number.
    dealt = index.shards.repartition(max(1, ceil(index.n_shards / TASK_SHARDS)))
    pairs = dealt.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = pairs.join(broadcast_if_small(packed, BROADCAST_BYTES), "q_block")
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[Heap]] = {}
        numbers = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                shard = Shard(row, n_docs, n_terms)
                starts = np.frombuffer(row["starts"], np.int64)
                terms, weights = np.frombuffer(row["q_terms"], np.uint64), np.frombuffer(row["q_weights"], np.int64)
                numbers[row["q_block"]] = np.frombuffer(row["numbers"], np.int64)
                own = heaps.setdefault(row["q_block"], [Heap(k) for _ in range(len(starts) - 1)])
                for q, best in enumerate(own):
                    part = slice(starts[q], starts[q + 1])
                    shard.search(terms[part], weights[part], best)
        for block, own in heaps.items():
            sizes = [len(h.ids) for h in own]
            ids = pa.array(np.concatenate([h.ids for h in own]), pa.int64(), mask=np.concatenate([h.missing for h in own]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(sum(sizes), block, np.int32)), pa.array(np.repeat(numbers[block], sizes)), ids, pa.array(np.concatenate([h.score for h in own]))],
                names=["q_block", "number", "doc_id", "score"])

    best = pairs.mapInArrow(run, "q_block int, number long, doc_id long, score long")
    order = Window.partitionBy("q_block", "number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(broadcast_if_small(items, BROADCAST_BYTES), ["q_block", "number"]).select("item_id", "rank", "doc_id", "score")


def topk(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Rank all of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Null and empty texts have no terms, so they are no hits and count nowhere;
    rows of one doc_id are documents of their own, rows of one item_id one query.
    Other columns are ignored; empty tables give an empty result.
    """
    asked = query_terms(items)
    return search(build(docs, asked), asked, k)
