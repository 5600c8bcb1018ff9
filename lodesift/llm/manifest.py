"""Merkle manifests of datasets, kept by aligned appends with incremental witnesses.

A document is a leaf: the SHA-256 of its fields.  The leaves of a source ascend
by id; runs of ``RUN`` nodes become their hash, level by level, up to the
subroot of the source, and the subroots become the root in the same way.

Leaves arrive in order at a :class:`Frontier`.  It keeps one open run a level;
the sibling that completes a run closes it, which extends the witnesses of all
nodes below by one step and appends the run's hash one level up.  A witness
belongs to a subtree, not to a leaf, so it is kept once.

Spark deals the leaves to aligned blocks of ``BLOCK`` leaves, each with a
frontier of its own.  The roots of blocks are then leaves of further blocks,
appended in the same way until a tree has one node left: about log(n) to the
base ``BLOCK`` rounds, each over 1/``BLOCK`` of the rows of the one before.  No
text is shuffled, and no task holds more than a block of a source of any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.sizing import broadcast_if_small
from ..session import materialise

RUN = 16
#: Levels of a block, and the leaves it holds.
LEVELS = 2
BLOCK = RUN**LEVELS
BROADCAST_BYTES = 32 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCKS = "key string, block long, total long, ids array<long>, leaves string, changed_at array<int>, changed string, root string"
_STEPS = "key string, block long, pos long, total long, places array<int>, others array<string>, root string"


def _digest(data: str) -> str:
    return sha256(data.encode()).hexdigest()


class Frontier:
    """The nodes of a subtree by level, each level with its open run, while nodes are appended in order."""

    def __init__(self) -> None:
        self.levels: list[list[str]] = [[]]

    def append(self, node: str, level: int = 0) -> None:
        """Add a node; if it completes a run, close that run and append its hash above."""
        if level == len(self.levels):
            self.levels.append([])
        nodes = self.levels[level]
        nodes.append(node)
        if len(nodes) % RUN == 0 and level < LEVELS:
            self.append(_digest("".join(nodes[-RUN:])), level + 1)

    def close(self, more: bool) -> None:
        """Close open runs: all levels of a block if its tree holds ``more`` than it, else until one node is left."""
        level = 0
        while level < LEVELS and (more or len(self.levels[level]) > 1):
            open_run = len(self.levels[level]) % RUN
            if open_run:
                self.append(_digest("".join(self.levels[level][-open_run:])), level + 1)
            level += 1
        self.levels = self.levels[:level + 1]

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def step(self, level: int, at: int) -> tuple[int, str]:
        """One step of a witness: the place of node ``at`` in its run, and the other nodes of the run."""
        begin = at // RUN * RUN
        run = self.levels[level][begin:begin + RUN]
        return at - begin, "".join(run[:at - begin] + run[at - begin + 1:])

    def witness(self, at: int, levels: Iterable[int] | None = None) -> list[tuple[int, str]]:
        """The steps from leaf ``at`` up to the root of the subtree."""
        return [self.step(n, at // RUN**n) for n in (range(len(self.levels) - 1) if levels is None else levels)]


def grown(nodes: Iterable[str], more: bool) -> Frontier:
    frontier = Frontier()
    for node in nodes:
        frontier.append(node)
    frontier.close(more)
    return frontier


def fold(node: str, steps: Iterable[tuple[int, str]]) -> str:
    """The root that a node and the steps of its witness lead to."""
    for place, others in steps:
        node = _digest(others[:64 * place] + node + others[64 * place:])
    return node


def leaf_of(**changed: Column) -> Column:
    """The hash of a document's fields, some of them replaced."""
    fields = (changed.get(f, F.col(f)).cast("string") for f in FIELDS)
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


def tampered(text: str = "text") -> Column:
    """The text in lower case (A-Z only) for a fifth of all ids, else null."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(picked, F.translate(text, _UPPER, _LOWER))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (key, ...) with ``pos``, their place by ``order`` within the key, and ``total``, the key's rows.

    One shuffle by ranges of (key, order).  A key of any size spreads over
    tasks; only a count for each task and key is joined back.
    """
    names = [*rows.columns, "part", "place"]
    at = rows.columns.index("key")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            coded = batch.column(at).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
            if coded.dictionary[codes[0]].as_py() == last:
                place[:begins[1] if len(begins) > 1 else n] += seen
            last, seen = coded.dictionary[codes[-1]].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place)], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = materialise(ranged.mapInArrow(number, f"{schema}, part int, place long"), "placed")
    sizes = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    of_key = Window.partitionBy("key")
    before = F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialise(sizes.select("key", "part", F.coalesce(before, F.lit(0)).alias("base"), F.sum("n").over(of_key).alias("total")), "bases")
    joined = placed.join(broadcast_if_small(bases, BROADCAST_BYTES), ["key", "part"])
    return joined.withColumn("pos", F.col("base") + F.col("place")).drop("part", "place", "base")


def _pack(table: pa.Table) -> pa.Table:
    """A block of leaves as one row, with its root."""
    table = table.sort_by("pos")
    leaves, now, total = table["leaf"].to_pylist(), table["now"].to_pylist(), table["total"][0].as_py()
    changed = [n for n, leaf in enumerate(now) if leaf is not None]
    return pa.table({
        "key": table["key"][:1], "block": pa.array([table["pos"][0].as_py() // BLOCK]), "total": pa.array([total]),
        "ids": pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())), "leaves": ["".join(leaves)],
        "changed_at": pa.array([changed], pa.list_(pa.int32())), "changed": ["".join(now[n] for n in changed)],
        "root": [grown(leaves, total > BLOCK).root],
    })


def _leaves(docs: DataFrame, now: Column | None) -> DataFrame:
    # Stored first: the salt tells equal rows apart in the ranges, so it has to stay what it is.
    wanted = docs.select(*FIELDS).withColumn("now_text", now if now is not None else F.lit(None).cast("string"))
    leaf = leaf_of()
    changed = F.when(F.col("now_text").isNotNull(), leaf_of(text=F.col("now_text")))
    return materialise(wanted.select(
        F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf.alias("leaf"), changed.alias("now"), F.monotonically_increasing_id().alias("salt")), "leaves")


def _packed(numbered: DataFrame) -> DataFrame:
    rows = numbered.select("key", "doc_id", "leaf", "now", "total", "pos").withColumn("block", F.floor(F.col("pos") / BLOCK))
    return materialise(rows.groupBy("key", "block").applyInArrow(_pack, _BLOCKS), "blocks")


def build(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """The manifest of a table (doc_id, source, lang, n_chars, text): a row for each block of leaves.

    ``now`` is the text as a later reader finds it (null: unchanged); its hashes
    are kept for :func:`proofs`.  Null fields are hashed as ``-``, an empty text
    as its length 0.  A null source is a source of its own and comes first, a
    null id comes first in its source.  Rows of one id are leaves of their own,
    in the order of their hashes.  Other columns are ignored; an empty table has
    no blocks.
    """
    return _packed(_numbered(_leaves(docs, now), ["doc_id", "leaf", "now", "salt"]))


def extend(blocks: DataFrame, docs: DataFrame, now: Column | None = None) -> DataFrame:
    """The manifest after an append: only the open block of a source is read and written again.

    Within a source the new ids must come after all that are there.
    """
    fresh = _numbered(_leaves(docs, now), ["doc_id", "leaf", "now", "salt"])
    old = blocks.groupBy("key").agg(F.max("total").alias("had"), F.max(F.array_max("ids")).alias("last"))
    late = fresh.join(old, "key").filter(F.coalesce(F.col("doc_id") <= F.col("last"), F.lit(True))).first()
    if late:
        raise ValueError(f"not an append: id {late['doc_id']} does not come after {late['last']}")
    had = F.coalesce("had", F.lit(0))
    grew = fresh.groupBy("key").agg(F.max("total").alias("more"))
    fresh = fresh.join(old.select("key", "had"), "key", "left").withColumn("pos", F.col("pos") + had)
    fresh = fresh.withColumn("total", F.col("total") + had).select("key", "doc_id", "leaf", "now", "total", "pos")
    after = blocks.join(grew, "key", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0)))
    is_open = F.col("more").isNotNull() & (F.size("ids") < BLOCK)
    place = F.array_position(F.transform("changed_at", lambda x: x.cast("long")), F.col("i").cast("long"))
    again = after.filter(is_open).select("key", "block", "total", "leaves", "changed", "changed_at", F.posexplode("ids").alias("i", "doc_id")).select(
        "key", "doc_id", F.substring("leaves", F.col("i") * 64 + 1, F.lit(64)).alias("leaf"),
        F.when(place > 0, F.expr("substring(changed, cast((array_position(transform(changed_at, x -> cast(x as long)), cast(i as long)) - 1) * 64 + 1 as int), 64)")).alias("now"),
        "total", (F.col("block") * BLOCK + F.col("i")).alias("pos"))
    return _packed(fresh.unionByName(again)).unionByName(after.filter(~is_open).select(*blocks.columns))


def _step_rows(table: pa.Table) -> pa.Table:
    """A block of inner nodes: the witness of each up to the root of the block."""
    table = table.sort_by("pos")
    total, n = table["total"][0].as_py(), table.num_rows
    frontier = grown(table["digest"].to_pylist(), total > BLOCK)
    steps = [frontier.witness(at) for at in range(n)]
    return pa.table({
        "key": table["key"], "block": pa.array([table["pos"][0].as_py() // BLOCK] * n), "pos": table["pos"], "total": table["total"],
        "places": pa.array([[s[0] for s in x] for x in steps], pa.list_(pa.int32())),
        "others": pa.array([[s[1] for s in x] for x in steps], pa.list_(pa.string())), "root": [frontier.root] * n,
    })


def _climb(nodes: DataFrame) -> DataFrame:
    """(key, pos, places, others, root) of nodes (key, pos, digest, total): witnesses up to the root of each tree.

    The nodes are appended block by block; the roots of blocks are appended
    again until each tree has one, and extend the witnesses below them.
    """
    blocks = nodes.select("key", "pos", "digest", "total").groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block"))
    steps = materialise(blocks.applyInArrow(_step_rows, _STEPS), "witnesses")
    open_trees = steps.filter((F.col("total") > BLOCK) & (F.col("pos") % BLOCK == 0))
    if open_trees.isEmpty():
        return steps.select("key", "pos", "places", "others", "root")
    above = _climb(open_trees.select("key", F.col("block").alias("pos"), F.col("root").alias("digest"), F.ceil(F.col("total") / BLOCK).alias("total")))
    above = above.select("key", F.col("pos").alias("block"), F.col("places").alias("more_places"), F.col("others").alias("more_others"), F.col("root").alias("top"))
    joined = steps.join(broadcast_if_small(above, BROADCAST_BYTES), ["key", "block"], "left")
    return joined.select(
        "key", "pos", F.concat("places", F.coalesce("more_places", F.array().cast("array<int>"))).alias("places"),
        F.concat("others", F.coalesce("more_others", F.array().cast("array<string>"))).alias("others"), F.coalesce("top", "root").alias("root"))


def witnesses(blocks: DataFrame) -> DataFrame:
    """(key, block, places, others, subroot, root): the steps from the root of every block up to that of the dataset."""
    inner = materialise(_climb(blocks.select("key", F.col("block").alias("pos"), F.col("root").alias("digest"), F.ceil(F.col("total") / BLOCK).alias("total"))), "inner")
    subroots = inner.filter("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("tree"), F.col("root").alias("digest"))
    tops = materialise(subroots, "subroots")
    placed = materialise(_numbered(tops, ["tree"]), "sources")
    top = _climb(placed).join(placed.select("pos", "tree"), "pos").select(
        F.col("tree").alias("key"), F.col("places").alias("top_places"), F.col("others").alias("top_others"), F.col("root").alias("top"))
    joined = inner.join(broadcast_if_small(materialise(top, "tops"), BROADCAST_BYTES), "key")
    return joined.select(
        "key", F.col("pos").alias("block"), F.concat("places", "top_places").alias("places"), F.concat("others", "top_others").alias("others"),
        F.col("root").alias("subroot"), F.col("top").alias("root"))


def _proof_rows(row: dict) -> dict[str, list]:
    hexes = row["leaves"]
    leaves = [hexes[n:n + 64] for n in range(0, len(hexes), 64)]
    now = dict(zip(row["changed_at"], (row["changed"][n:n + 64] for n in range(0, len(row["changed"]), 64))))
    frontier = grown(leaves, row["total"] > BLOCK)
    above = list(zip(row["places"], row["others"]))
    tail = "".join(row["others"])
    tops: dict[str, str] = {}
    proofs, folded = [], []
    for at, leaf in enumerate(leaves):
        steps = frontier.witness(at)
        proofs.append(_digest("".join(others for _, others in steps) + tail))
        inner = fold(now.get(at, leaf), steps)
        if inner not in tops:
            tops[inner] = fold(inner, above)
        folded.append(tops[inner])
    n = len(leaves)
    return {
        "doc_id": row["ids"], "leaf": leaves, "subroot": [row["subroot"]] * n, "root": [row["root"]] * n,
        "proof_sha256": proofs, "folded_root": folded, "verified": [f == row["root"] for f in folded],
    }


def proofs(blocks: DataFrame) -> DataFrame:
    """A row per leaf: its hash, subroot, root, the hash of its witness, and the root that its present content folds to.

    ``verified`` tells whether that is the root.  An empty manifest gives none.
    """
    above = materialise(witnesses(blocks), "above")
    joined = blocks.drop("root").join(broadcast_if_small(above, BROADCAST_BYTES), ["key", "block"])
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict(_proof_rows(batch.slice(at, 1).to_pylist()[0]), schema)

    return joined.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def audited(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """The manifest of ``docs`` with the proof of every document, and whether its text as ``now`` is still the same.

    Nulls, repeated rows and empty tables: as in :func:`build`.
    """
    return proofs(build(docs, now))
