"""Exact n-gram Jaccard links between documents with a token-group matrix.

1. Texts with equal shingle sets are one class.  Every chunk of documents sends
   its distinct shingles, packed, to ranges of the key space and learns which of
   them occur in another class too, and in how many.  A document can only link
   if enough of its shingles do; the others are done.
2. What is left is partitioned into groups of similar documents: those that
   share a minimum hash meet in blocks of bounded size, join the first leader
   they link with, and leaders meet again under other hashes.  A group is linked
   throughout, so nothing inside it has to be compared again.
3. The matrix holds, for each group, the union of the rarest shingles of its
   documents; what has found no link yet is grouped by the first block it met.  A document is a candidate for another group if they share one of
   them; with thresholds on both sizes this loses no link.  A candidate group is
   opened block by block: if the overlap with the union of a block is too small,
   no document in it can link, else they are compared.

One link between two groups is enough for their component.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .components import components
from .packed import bits, from_bits, pack, runs, stored, unpack
from .words import Texts, mix, shingles, slices, texts_of, word_hashes, words_of

CHUNK_BYTES = 2 << 20
RANGE = 2_000_000
BROADCAST_BYTES = 64 << 20
#: Documents that meet in one block, and rounds in which leaders meet.
BLOCK, ROUNDS = 128, 3
_MULTI = np.uint16(0xFFFF)


def _sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text (by text, then by hash), their texts, set sizes, and a key of each set."""
    low = texts.lowered()
    words = words_of(low)
    h, owner = shingles(word_hashes(low, words), words, size)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = runs(owner, h)
    h, owner = h[first], owner[first]
    n = np.bincount(owner, minlength=texts.count)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h))))
    ends = np.cumsum(n)
    return h, owner, n, mix(total[ends] - total[ends - n] + n.astype(np.uint64)).view(np.int64)


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """Documents in chunks with the size and the key of every set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece, texts in slices(batch, "text", CHUNK_BYTES):
                _, _, n, key = _sets(texts, size)
                whole = pa.array([0, piece.num_rows], pa.int32())
                columns = [*piece.columns, pa.array(n), pa.array(key, mask=(n == 0))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.ListArray.from_arrays(whole, c) for c in columns)], names=["chunk", "ids", "texts", "sizes", "keys"])
                number += 1

    return docs.mapInArrow(run, "chunk long, ids array<long>, texts array<string>, sizes array<long>, keys array<long>")


def _edges(ranges: int, width: int) -> np.ndarray:
    return np.array([(p << (8 * width)) // ranges for p in range(1, ranges)], np.uint64)


class _Chunk:
    """Shingles of the first text of each class in a chunk, and their cells."""

    def __init__(self, batch: pa.RecordBatch, row: int, size: int, width: int):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[row]
        self.number = get("chunk").as_py()
        h, owner, n, key = _sets(texts_of(get("texts").values), size)
        _, first = np.unique(np.where(n > 0, key, 0), return_index=True)
        chosen = np.zeros(len(n), bool)
        chosen[first] = True
        chosen &= n > 0
        self.tokens, self.owner = h[chosen[owner]], owner[chosen[owner]]
        self.sizes, self.keys = n, key
        self.cells, self.cell_of, self.counts = np.unique(self.tokens >> np.uint64(64 - 8 * width), return_inverse=True, return_counts=True)


def _chunks(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[tuple[_Chunk, list]]:
    for batch in batches:
        replies = batch.column(batch.schema.get_field_index("replies")) if "replies" in batch.schema.names else None
        for row in range(batch.num_rows):
            yield _Chunk(batch, row, size, width), (replies[row].as_py() or []) if replies is not None else []


def _merge(width: int):
    """Which cells of each chunk occur in two classes or more, and the logarithm of how many."""
    def run(table: pa.Table) -> pa.Table:
        cells, classes, several, sizes = [], [], [], []
        for packed, owners, known in zip(*(table[c].to_pylist() for c in ("cells", "owners", "keys"))):
            cells.append(unpack(packed, width))
            owner = np.frombuffer(owners, np.uint16)
            keys = np.append(np.frombuffer(known, np.int64), 0)
            multi = owner == _MULTI
            classes.append(keys[np.where(multi, len(keys) - 1, owner)])
            several.append(multi)
            sizes.append(len(owner))
        cells, classes, several = np.concatenate(cells), np.concatenate(classes), np.concatenate(several)
        order = np.argsort(cells, kind="stable")
        begin = runs(cells[order])
        level = np.zeros(len(cells), np.uint8)
        if len(begin):
            low, high = np.minimum.reduceat(classes[order], begin), np.maximum.reduceat(classes[order], begin)
            often = (low != high) | np.logical_or.reduceat(several[order], begin)
            amount = np.diff(np.append(begin, len(cells))) + np.add.reduceat(several[order].astype(np.int64), begin)
            value = np.where(often, 1 + np.minimum(np.log2(amount), 62).astype(np.int64), 0).astype(np.uint8)
            level[order] = np.repeat(value, np.diff(np.append(begin, len(cells))))
        replies, levels, at = [], [], 0
        for n in sizes:
            part = level[at:at + n]
            replies.append(bits(part > 0))
            levels.append(part[part > 0].tobytes())
            at += n
        return pa.table({"chunk": table["chunk"], "place": table["place"], "bits": pa.array(replies, pa.binary()), "levels": pa.array(levels, pa.binary())})
    return run


def linkable(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, key) of all documents, and (key, n, tokens) of each class that may link.

    ``tokens`` are the shingles that occur in another class too, the rarest first.
    """
    chunks = stored(chunked(docs, size), "chunks")
    total = chunks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    ranges = ceil(total / RANGE) or 1
    width = min(8, max(5, ceil((log2(max(total, 1)) + 12) / 8)))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches, size, width):
            owner = np.zeros(len(chunk.cells), np.int64)
            owner[chunk.cell_of] = chunk.owner
            bounds = np.concatenate(([0], np.searchsorted(chunk.cells, _edges(ranges, width)), [len(chunk.cells)]))
            for p in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[p], bounds[p + 1])
                known, short = np.unique(owner[part], return_inverse=True)
                short = np.where(chunk.counts[part] > 1, _MULTI, short.astype(np.uint16)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.number]), pa.array([p], pa.int32()), pa.array([pack(chunk.cells[part], width)]), pa.array([short.tobytes()]), pa.array([chunk.keys[known].tobytes()])],
                    names=["chunk", "place", "cells", "owners", "keys"])

    cells = chunks.select("chunk", "texts").mapInArrow(sent, "chunk long, place int, cells binary, owners binary, keys binary")
    merged = cells.repartition(ranges, "place").groupBy("place").applyInArrow(_merge(width), "chunk long, place int, bits binary, levels binary")
    merged = stored(merged, "replies")
    bulk = merged.agg(F.coalesce(F.sum(F.octet_length("bits") + F.octet_length("levels") + 64), F.lit(0))).first()[0]
    listed = merged.groupBy("chunk").agg(F.collect_list(F.struct("place", "bits", "levels")).alias("replies"))
    answered = chunks.select("chunk", "texts").join(F.broadcast(listed) if bulk <= BROADCAST_BYTES else listed, "chunk")

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, replies in _chunks(batches, size, width):
            bounds = np.concatenate(([0], np.searchsorted(chunk.cells, _edges(ranges, width)), [len(chunk.cells)]))
            level = np.zeros(len(chunk.cells), np.uint8)
            for reply in replies:
                there = slice(bounds[reply["place"]], bounds[reply["place"] + 1])
                part = np.zeros(there.stop - there.start, np.uint8)
                part[from_bits(reply["bits"], len(part))] = np.frombuffer(reply["levels"], np.uint8)
                level[there] = part
            level = level[chunk.cell_of]
            met = level > 0
            shared = np.bincount(chunk.owner[met], minlength=len(chunk.sizes))
            fine = (shared * 100 >= percent * chunk.sizes) & (shared > 0)
            rows = met & fine[chunk.owner]
            tokens, owner, level = chunk.tokens[rows], chunk.owner[rows], level[rows]
            order = np.lexsort((tokens, level, owner))
            texts = np.flatnonzero(fine)
            ends = np.concatenate(([0], np.cumsum(shared[texts])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.keys[texts]), pa.array(chunk.sizes[texts]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens[order].view(np.int64)))],
                names=["key", "n", "tokens"])

    found = answered.mapInArrow(left, "key long, n long, tokens array<long>").dropDuplicates(["key"])
    rows = chunks.select(F.explode(F.arrays_zip("ids", "sizes", "keys")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.sizes").alias("n"), F.col("x.keys").alias("key"))
    return rows, stored(found, "linkable")


def _tokens(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, o = whole.values.to_numpy(), whole.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(o[:-1], o[1:])]


def _lead(percent: int):
    """Each document of a block joins the first leader it links with, or leads itself."""
    def run(table: pa.Table) -> pa.Table:
        keys, n = table["key"].to_numpy(), table["n"].to_numpy()
        lists = _tokens(table["tokens"])
        own = np.array([len(t) for t in lists])
        flat, at = np.unique(np.concatenate(lists), return_inverse=True)
        lists = np.split(at, np.cumsum(own)[:-1])
        mark = np.zeros(len(flat), bool)
        leaders: list[int] = []
        leader = keys.copy()
        for i in np.lexsort((keys, n, n - own)):  # the most typical first
            mark[lists[i]] = True
            for j in leaders:
                if 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]):
                    both = int(np.count_nonzero(mark[lists[j]]))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        leader[i] = keys[j]
                        break
            else:
                leaders.append(i)
            mark[lists[i]] = False
        return pa.table({"key": pa.array(keys), "leader": pa.array(leader), "least": table["least"], "block": table["block"]})
    return run


def _blocks(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with a block number such that those equal in ``by`` fall into blocks of about ``BLOCK``."""
    sizes = materialise(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(f"{name}s")), "sizes")
    return rows.join(sizes, by).withColumn(name, F.pmod(F.xxhash64("key", F.lit(name)), F.col(f"{name}s")).cast("int"))


def groups(docs: DataFrame, percent: int) -> DataFrame:
    """(key, group, cell): documents under a leader they are connected to, and the group of the matrix they belong to.

    A linked group is one of the matrix.  Documents that lead nobody have met
    those of their first block already and form a group of the matrix with them.
    """
    known = docs.select("key", F.col("key").alias("group"))
    first = None
    leading = docs
    for seed in range(ROUNDS):
        least = F.array_min(F.transform("tokens", lambda x: F.xxhash64(x, F.lit(seed))))
        met = _blocks(leading.withColumn("least", least), ["least"], "block")
        pairs = met.select("least", "block", "key", "n", "tokens").groupBy("least", "block").applyInArrow(_lead(percent), "key long, leader long, least long, block int")
        pairs = materialise(pairs, "leaders")
        first = first or pairs.select("key", F.xxhash64("least", "block").alias("met"))
        known = known.join(pairs.select(F.col("key").alias("group"), "leader"), "group").select("key", F.col("leader").alias("group"))
        leading = leading.join(pairs.filter("key = leader").select("key"), "key", "left_semi")
    known = materialise(known, "groups")
    sizes = materialise(known.groupBy("group").count(), "group-sizes")
    cell = F.when(F.col("count") > 1, F.col("group")).otherwise(F.col("met"))
    return materialise(known.join(sizes, "group").join(first, "key").select("key", "group", cell.alias("cell")), "cells")


def _needed(n: Column, percent: int, doubled: bool) -> Column:
    """Shingles that a link of a document needs: with any partner, or with one that is not smaller."""
    return F.ceil((2 * percent * n) / F.lit(100.0 + percent)).cast("int") if doubled else F.ceil(percent * n / F.lit(100.0)).cast("int")


def _open(percent: int):
    """Compare candidate documents with one block of a group of the matrix, if its union has enough of their shingles."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found_key, found_group = [], []
        if left.num_rows and right.num_rows:
            n, groups, lists = right["n"].to_numpy(), right["group"].to_numpy(), _tokens(right["tokens"])
            own = np.array([len(t) for t in lists])
            union, at = np.unique(np.concatenate(lists), return_inverse=True)
            first = np.cumsum(own) - own
            for group, m, tokens in zip(left["own_group"].to_pylist(), left["n"].to_pylist(), _tokens(left["tokens"])):
                place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                place = place[union[place] == tokens]
                if (100 + percent) * len(place) < percent * (m + int(n.min())):
                    continue
                mark = np.zeros(len(union), np.int64)
                mark[place] = 1
                both = np.add.reduceat(mark[at], first)
                met = np.unique(groups[100 * both >= percent * (n + m - both)]).tolist()
                found_key += [group] * len(met)
                found_group += met
        return pa.table({"u": pa.array(found_key, pa.int64()), "v": pa.array(found_group, pa.int64())})
    return run


def group_links(docs: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """(u, v): groups that a verified link of two of their documents connects."""
    docs = materialise(docs.join(grouped, "key").withColumn("shared", F.size("tokens")), "grouped")
    shared = F.col("shared")
    probe = docs.withColumn("rare", F.slice("tokens", F.lit(1), F.greatest(shared - _needed(F.col("n"), percent, False) + 1, F.lit(0))))
    index = docs.withColumn("rare", F.slice("tokens", F.lit(1), F.greatest(shared - _needed(F.col("n"), percent, True) + 1, F.lit(0))))
    matrix = index.select("cell", "n", "shared", F.explode("rare").alias("token")).groupBy("token", "cell")
    matrix = materialise(matrix.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("shared").alias("most")), "matrix")
    asked = probe.select("key", "n", "shared", F.col("cell").alias("own"), F.explode("rare").alias("token"))
    # Sizes must allow a link, and neither side can share more than occurs elsewhere at all.
    fits = (
        (F.col("own") != F.col("cell")) & (F.col("low") <= F.col("n")) & (F.col("high") * 100 >= F.col("n") * percent)
        & (F.least("shared", "most") * (100 + percent) >= percent * (F.col("n") + F.col("low")))
    )
    wanted = materialise(asked.join(matrix, "token").filter(fits).select("key", "cell").distinct(), "candidates")
    members = _blocks(docs.join(wanted.select("cell").distinct(), "cell", "left_semi").select("cell", "group", "key", "n", "tokens"), ["cell"], "block")
    members = materialise(members, "members")
    queries = _blocks(wanted, ["cell"], "part")
    queries = queries.join(members.select("cell", "blocks").distinct(), "cell")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "part", "key")
    queries = queries.join(docs.select("key", "n", "tokens", F.col("group").alias("own_group")), "key")
    parts = materialise(queries.select("cell", "block", "part").distinct(), "parts")
    copies = members.drop("blocks").join(parts, ["cell", "block"])
    by = ["cell", "block", "part"]
    return queries.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(_open(percent), "u long, v long")


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a
    set holds the distinct shingles of ``size`` words, or the whole sequence if
    it is shorter.  Documents link if their sets overlap by ``percent`` of the
    union or more; the component is the smallest id that links reach.  A null or
    empty text has no shingles and links with nothing.  Repeated rows all
    return; rows of one id with different texts are judged by their own text.  A
    null id has a null component.  Other columns are left out.
    """
    rows, able = linkable(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), size, percent)
    grouped = groups(able, percent)
    joined = components(group_links(able, grouped, percent))
    least = rows.filter("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"))
    whole = grouped.join(joined.withColumnsRenamed({"node": "group"}), "group", "left").select("key", F.coalesce("component", "group").alias("component"))
    whole = materialise(least.join(whole, "key", "left").select("key", "least", "component"), "classes")
    smallest = materialise(whole.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("smallest")), "components")
    known = materialise(whole.join(smallest, "component", "left").select("key", F.coalesce("smallest", "least").alias("component_id")), "known")
    return rows.join(known, "key", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
