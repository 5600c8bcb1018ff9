"""Near-duplicate vectors over a robust-pruned flat graph.

Vectors of a label are dealt to the ``OVERLAP`` nearest of its centroids, so
shards overlap.  Each shard builds a graph: near neighbours after robust pruning,
far ones after the same rule, their reverses, and a path from the medoid to
every vector.  The lists a vector has in its shards are united.  A search walks
from the medoid of a shard greedily with a beam, then expands its range: all
neighbours of what is within the threshold, until nothing new is.  Every link is
verified in double precision.  A link of two vectors that share several shards
counts in the first of them.

Equal vectors are one class with a weight.  A shard of more than ``BLOCK``
vectors is cut into blocks; all of its vectors search every block.  Within a
task links become counts and a spanning forest; pairs never leave it.  At the
end the recall of a bounded sample is measured against a scan of all rows, and
the overlap grows until it reaches ``RECALL``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .components import components

OVERLAP = 2
#: Vectors that a shard should have and that a block has at most, about.
SHARD, BLOCK = 1000, 2000
#: Vectors that centroids are fitted on, centroids of all labels together, and rounds of the fit, at most.
SAMPLE, CENTROIDS, ROUNDS = 20_000, 4096, 5
NEAR, FAR, CANDIDATES, ALPHA, BEAM = 16, 8, 48, 1.2, 24
#: Vectors that audit the search, and the share of their links that must be found.
AUDIT, RECALL = 200, 0.97


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _stack(binary: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(binary), np.float64).reshape(len(binary), -1)


def classes_of(vectors: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(vec, key) of all rows that can link, and one row per class of equal vectors: rep, weight, group, unit vector."""
    c = F.col(vector)
    usable = F.col(label).isNotNull() & c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(c, lambda x: x != 0)
    group = F.concat_ws("/", F.col(label).cast("string"), F.size(c).cast("string"))
    rows = vectors.filter(usable & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec"), group.alias("group"), c.cast("array<double>").alias("vector"),
        F.concat_ws("/", group, F.hex(F.xxhash64(c)), F.hex(F.xxhash64(F.lit(7), c))).alias("key"))
    found = rows.groupBy("key").agg(F.min("vec").alias("rep"), F.countDistinct("vec").alias("weight"), F.first("group").alias("group"), F.first("vector").alias("vector"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4).to_pylist()
            units = []
            for x in lists:
                v = np.array(x, np.float64)
                v = v / np.abs(v).max()  # squares of large or small components stay finite
                units.append((v / np.linalg.norm(v)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(units, pa.binary())], names=["key", "rep", "weight", "group", "unit"])

    return rows.select("vec", "key"), found.mapInArrow(unit, "key string, rep long, weight long, group string, unit binary")


def fit_centroids(classes: DataFrame, overlap: int) -> dict[str, np.ndarray]:
    """Centroids of each label from a bounded sample, as many as its share of the shards."""
    sizes = {r["group"]: r["count"] for r in classes.groupBy("group").count().collect()}
    total = sum(sizes.values())
    share = min(1.0, SAMPLE / max(total, 1))
    picked = classes.filter(F.pmod(F.xxhash64(F.lit("fit"), "rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    vectors: dict[str, list[bytes]] = {}
    for r in picked.select("group", "unit").orderBy("rep").limit(2 * SAMPLE).collect():
        vectors.setdefault(r["group"], []).append(r["unit"])
    wanted = {g: ceil(overlap * n / SHARD) for g, n in sizes.items()}
    cut = min(1.0, CENTROIDS / max(sum(wanted.values()), 1))
    found = {}
    for g, units in vectors.items():
        x = _stack(units)
        k = max(1, min(len(x), int(wanted[g] * cut)))
        centers = x[np.random.default_rng(len(x)).choice(len(x), k, replace=False)]
        for _ in range(ROUNDS if k > 1 else 0):
            own = np.argmax(x @ centers.T, 1)
            for j in range(k):
                mean = x[own == j].sum(0)
                if np.linalg.norm(mean) > 0:
                    centers[j] = mean / np.linalg.norm(mean)
        found[g] = centers
    return found


def assigned(classes: DataFrame, centroids: dict[str, np.ndarray], overlap: int) -> DataFrame:
    """A row for each class and shard it belongs to; ``shards`` are all of its shards."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for group, unit in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                centers = shared.value.get(group)
                near = np.zeros(1, np.int64) if centers is None else np.argsort(-(centers @ np.frombuffer(unit)), kind="stable")[:overlap]
                lists.append(sorted(near.tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["rep", "weight", "group", "unit", "shards"])

    return classes.select("rep", "weight", "group", "unit").mapInArrow(run, "rep long, weight long, group string, unit binary, shards array<int>").withColumn("shard", F.explode("shards"))


def robust_prune(x: np.ndarray, candidates: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none): take the nearest, drop those much nearer to it, repeat."""
    n, m = candidates.shape
    kept = np.full((n, degree), -1, np.int64)
    alive = candidates >= 0
    held = x[np.maximum(candidates, 0)]
    own = 2 - 2 * np.einsum("nd,nmd->nm", x, held)
    for k in range(degree):
        pick = np.argmax(alive, 1)
        rows = np.flatnonzero(alive[np.arange(n), pick])
        if not len(rows):
            break
        p = candidates[rows, pick[rows]]
        kept[rows, k] = p
        between = 2 - 2 * np.einsum("nd,nmd->nm", x[p], held[rows])
        alive[rows] &= alpha * between > own[rows]
        alive[rows, pick[rows]] = False
    return kept


def build(x: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Neighbour lists of all rows and the position of the medoid."""
    n = len(x)
    medoid = int(np.argmax(x @ x.sum(0)))
    if n == 1:
        return [np.zeros(0, np.int64)], medoid
    m = min(CANDIDATES, n - 1)
    near = np.empty((n, m), np.int64)
    for at in range(0, n, 512):
        s = x[at:at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        best = np.argpartition(-s, m - 1, axis=1)[:, :m]
        near[at:at + 512] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
    far = np.random.default_rng(n).integers(0, n, (n, 2 * FAR))
    far[far == np.arange(n)[:, None]] = medoid
    order = np.argsort(-np.einsum("nd,nmd->nm", x, x[far]), axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    edges = np.concatenate((robust_prune(x, near, NEAR), robust_prune(x, far, FAR, 1.0)), axis=1)
    a, b = np.repeat(np.arange(n), edges.shape[1]), edges.ravel()
    real = (b >= 0) & (a != b)
    a, b = np.concatenate((a[real], b[real])), np.concatenate((b[real], a[real]))
    # A path from the medoid to everything it does not reach.
    reach = spread_labels(n, a, b)
    lost = np.unique(reach[reach != reach[medoid]])
    a, b = np.concatenate((a, np.full(len(lost), medoid), lost)), np.concatenate((b, lost, np.full(len(lost), medoid)))
    pairs = np.unique(a * n + b)
    a, b = pairs // n, pairs % n
    return np.split(b, np.searchsorted(a, np.arange(1, n))), medoid


def spread_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` positions reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def range_search(x: np.ndarray, lists: list[np.ndarray], medoid: int, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) at or above the threshold: a beam from the medoid, then neighbours of all that is in range."""
    n, m = len(x), len(queries)
    width = max(map(len, lists))
    table = np.full((n, max(width, 1)), -1, np.int64)
    for i, near in enumerate(lists):
        table[i, :len(near)] = near
    seen = np.zeros((m, n), bool)
    beam = min(BEAM, n)
    ids, sims, done = np.full((m, beam), -1), np.full((m, beam), -2.0), np.ones((m, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0], seen[:, medoid] = medoid, queries @ x[medoid], False, True
    hit_query, hit_row = [np.flatnonzero(sims[:, 0] >= threshold)], [np.full(int((sims[:, 0] >= threshold).sum()), medoid)]

    def fresh(query: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen neighbours of (query, row) pairs, each once, with their similarity."""
        near = table[row]
        q = np.repeat(query, near.shape[1]).reshape(near.shape)
        ok = near >= 0
        ok[ok] = ~seen[q[ok], near[ok]]
        pairs = np.unique(q[ok] * n + near[ok])
        q, near = pairs // n, pairs % n
        seen[q, near] = True
        sim = np.einsum("ij,ij->i", queries[q], x[near])
        found = sim >= threshold
        hit_query.append(q[found])
        hit_row.append(near[found])
        return q, near, sim

    while True:
        pick = np.argmax(np.where(done, -3.0, sims), 1)
        rows = np.flatnonzero(~done[np.arange(m), pick])
        if not len(rows):
            break
        done[rows, pick[rows]] = True
        q, near, sim = fresh(rows, ids[rows, pick[rows]])
        if not len(q):
            continue
        counts = np.bincount(q, minlength=m)
        slot = np.arange(len(q)) - (np.cumsum(counts) - counts)[q]
        more = int(counts.max())
        new_ids, new_sims = np.full((m, more), -1), np.full((m, more), -2.0)
        new_ids[q, slot], new_sims[q, slot] = near, sim
        ids, sims = np.concatenate((ids, new_ids), 1), np.concatenate((sims, new_sims), 1)
        done = np.concatenate((done, new_ids < 0), 1)
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        ids, sims, done = (np.take_along_axis(v, best, 1) for v in (ids, sims, done))
    frontier_q, frontier_r = np.concatenate(hit_query), np.concatenate(hit_row)
    while len(frontier_q):
        before = len(hit_query)
        for at in range(0, len(frontier_q), 20_000):
            fresh(frontier_q[at:at + 20_000], frontier_r[at:at + 20_000])
        frontier_q, frontier_r = np.concatenate(hit_query[before:]), np.concatenate(hit_row[before:])
    return np.concatenate(hit_query), np.concatenate(hit_row)


def _build_shard(table: pa.Table) -> pa.Table:
    reps = table["rep"].to_numpy()
    lists, _ = build(_stack(table["unit"].to_pylist()))
    return pa.table({"rep": pa.array(reps), "near": pa.array([reps[near].tolist() for near in lists], pa.list_(pa.int64()))})


def _search_shard(threshold: float):
    """Counts and a spanning forest of the links found in one block."""
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        reps, weights, member = table["rep"].to_numpy(), table["weight"].to_numpy(), table["member"].to_numpy()
        units = _stack(table["unit"].to_pylist())
        rows = np.flatnonzero(member)
        if not len(rows):
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        rows = rows[np.argsort(reps[rows])]
        own = reps[rows]
        near = [np.array(v if v is not None else [], np.int64) for v in table["near"].take(pa.array(rows)).to_pylist()]
        lists = []
        for v in near:
            at = np.minimum(np.searchsorted(own, v), len(own) - 1)
            lists.append(at[own[at] == v])
        x = units[rows]
        medoid = int(np.argmax(x @ x.sum(0)))
        query, row = range_search(x, lists, medoid, units, threshold)
        row = rows[row]
        # Each pair counts in the first shard that its ends share.
        shards = table["shards"].to_pylist()
        width = max(map(len, shards))
        padded = np.array([s + [-1 - k] * (width - len(s)) for k, s in enumerate(shards)])
        other = reps[query] != reps[row]
        query, row = query[other], row[other]
        first = np.full(len(query), np.iinfo(np.int64).max)
        for i in range(width):
            for j in range(width):
                same = padded[query, i] == padded[row, j]
                first[same] = np.minimum(first[same], padded[query, i][same])
        mine = first == shard
        query, row = query[mine], row[mine]
        links = np.bincount(query, weights[row], len(reps)).astype(np.int64)
        order = np.argsort(reps, kind="stable")
        place = np.empty(len(reps), np.int64)
        place[order] = np.arange(len(reps))
        root = reps[order][spread_labels(len(reps), place[query], place[row])[place]]
        told = (links > 0) | (root != reps)
        return pa.table({"rep": pa.array(reps[told]), "links": pa.array(links[told]), "root": pa.array(root[told])})
    return run


def linked(classes: DataFrame, centroids: dict[str, np.ndarray], overlap: int, threshold: float) -> DataFrame:
    """(rep, links, root) of each class and block with links: the weight linked there, the smallest rep reached there."""
    placed = materialise(assigned(classes, centroids, overlap), "shards")
    sizes = placed.groupBy("group", "shard").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    placed = placed.join(F.broadcast(sizes), ["group", "shard"])  # at most CENTROIDS rows and a row per label
    placed = placed.withColumn("home", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    lists = placed.select("group", "shard", "home", "rep", "unit").groupBy("group", "shard", "home").applyInArrow(_build_shard, "rep long, near array<long>")
    graph = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    asked = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(graph, "rep", "left")
    asked = asked.select("group", "shard", "block", "rep", "weight", "unit", "shards", (F.col("block") == F.col("home")).alias("member"), "near")
    return asked.groupBy("group", "shard", "block").applyInArrow(_search_shard(threshold), "rep long, links long, root long")


def audit(classes: DataFrame, found: DataFrame, threshold: float) -> float:
    """The share of the true links of a bounded sample that were found; 1 where there are none."""
    total = classes.count()
    classes = classes.select("rep", "weight", "group", "unit")
    picked = classes.filter(F.pmod(F.xxhash64(F.lit("audit"), "rep"), F.lit(1 << 30)) < int(min(1.0, AUDIT / max(total, 1)) * (1 << 30)))
    # Half of the sample comes from classes with links, where there is something to miss.
    busy = found.filter("links > 0").select("rep").distinct()
    some = busy.filter(F.pmod(F.xxhash64(F.lit("busy"), "rep"), F.lit(1 << 30)) < int(min(1.0, AUDIT / max(busy.count(), 1)) * (1 << 30)))
    rows = picked.select("rep", "group", "unit").union(classes.join(F.broadcast(some), "rep").select("rep", "group", "unit")).distinct().limit(4 * AUDIT).collect()
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r["group"], []).append(r)
    sample = {g: (np.array([r["rep"] for r in rs]), _stack([r["unit"] for r in rs])) for g, rs in groups.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(2).to_pylist(), object)
            for g, (reps, units) in sample.items():
                rows = np.flatnonzero(names == g)
                if len(rows):
                    picked = batch.take(pa.array(rows))
                    near = (units @ _stack(picked.column(3).to_pylist()).T >= threshold) & (reps[:, None] != picked.column(0).to_numpy()[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(near @ picked.column(1).to_numpy())], names=["rep", "truth"])

    truth = classes.select("rep", "weight", "group", "unit").mapInArrow(scan, "rep long, truth long").groupBy("rep").agg(F.sum("truth").alias("truth"))
    both = truth.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").agg(F.sum("truth").alias("t"), F.sum("links").alias("l")).first()
    return (both["l"] or 0) / both["t"] if both["t"] else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept, audit_recall.

    Vectors link if their labels are equal and their cosine is ``threshold`` or
    more; equal vectors always do.  A null label, a null or zero vector or one
    with null or non-finite components links with nothing; vectors of different
    length do not link.  Rows of one id and vector are one vector; a null id links
    with nothing and is kept.  The smallest
    id of a component is kept.  ``audit_recall`` is the measured share of links
    found for the sample.  An empty table gives an empty result; other columns
    are left out.
    """
    keys, classes = classes_of(vectors, id_col, vector, label)
    classes = materialise(classes, "classes")
    overlap = OVERLAP
    while True:
        centroids = fit_centroids(classes, overlap)
        found = materialise(linked(classes, centroids, overlap, threshold), "links")
        recall = audit(classes, found, threshold)
        widest = max((len(c) for c in centroids.values()), default=0)
        if recall >= RECALL or overlap >= widest:
            break
        overlap = min(2 * overlap, widest)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    known = classes.select("key", "rep", "weight").join(links, "rep", "left").join(roots.withColumnsRenamed({"node": "rep"}), "rep", "left")
    known = materialise(known.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "known")
    by_id = keys.join(known, "key").groupBy("vec").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(by_id.withColumnsRenamed({"vec": "vec_id"}), "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"))
