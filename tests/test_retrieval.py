"""BM25, vectors, fusion, rerank and hybrid retrieval against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodesift.config import LexicalConfig, RetrievalConfig, SizeLimits
from lodesift.functions.vectors import normalise
from lodesift.operators.embed import HashedEncoder, embed
from lodesift.operators.fusion import fuse
from lodesift.operators import blocks, lexical
from lodesift.operators.lexical import bm25_search, corpus_statistics, read_corpus
from lodesift.operators import nearest as nearest_module
from lodesift.operators.nearest import (
    best_first,
    CentroidCells, PlaneCells, assign_cells, nearest, nearest_approximate, nearest_post_filtered, read_cells, recall_at_k,
    train_cells, write_cells,
)
from lodesift.operators.rerank import cut, query_scores, split_by_need
from lodesift.operators.sizing import broadcast_if_small, measure
from lodesift.plans.index import build_index, index_of, open_index
from lodesift.plans.retrieve import candidate_list, hybrid_hits, retrieve
from lodesift.session import materialise
from lodesift.sources.store import IndexStore

DOCS = [
    (0, "common apple apple pie"), (1, "common banana bread"), (2, "common apple tart"), (3, "common"), (4, ""),
    (5, "common cherry apple cake cake"), (6, "common banana bread"), (7, "x y z"),
]
QUERIES = [(0, "apple"), (1, "common"), (2, "apple apple pie"), (3, "zebra"), (4, "a b c"), (5, "banana bread common")]
TINY = SizeLimits(broadcast_bytes=0, block_rows=3)


def tok(text):
    return re.findall("[a-z0-9]{2,}", text.lower())


def plain_bm25(docs, queries, k, k1=1.5, b=0.75, eps=0.25):
    bags = {d: Counter(tok(t)) for d, t in docs}
    size = {d: sum(c.values()) for d, c in bags.items()}
    n, avgdl = len(docs), sum(size.values()) / len(docs)
    df = Counter(t for c in bags.values() for t in c)
    raw = {t: math.log(n - v + 0.5) - math.log(v + 0.5) for t, v in df.items()}
    average = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else eps * average for t, v in raw.items()}
    out = []
    for q, text in queries:
        scores = []
        for d, bag in bags.items():
            s = sum(idf.get(t, 0) * bag[t] * (k1 + 1) / (bag[t] + k1 * (1 - b + b * size[d] / avgdl)) for t in tok(text))
            if s > 0:
                scores.append((-round(s, 6), d))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


@pytest.mark.parametrize("limits", [SizeLimits(), SizeLimits(broadcast_bytes=200)])
def test_t3_bm25(docs, queries, rows, limits):
    for k in (1, 3, 20):
        got = rows(bm25_search(docs, queries, k, limits=limits), "query_id", "doc_id", "score", "rank")
        want = plain_bm25(DOCS, QUERIES, k)
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)


def test_bm25_plan(docs, queries):
    plan = bm25_search(docs, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "Filter (size(regexp_extract_all" not in plan        # tokens are made once
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan
    # Postings once by document, hits once by query.
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange hashpartitioning(query_id") == 1


def test_bm25_tasks_follow_pairs(spark, rows, monkeypatch):
    """A word that all documents and questions share: pairs decide the number of tasks, not the bytes of the words."""
    monkeypatch.setattr(lexical, "TASK_ROWS", 100, raising=False)
    data = [(n, f"shared word{n % 7}") for n in range(90)]
    asked = [(q, f"shared word{q % 9}") for q in range(30)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    hits = bm25_search(spark.createDataFrame(data, "doc_id long, text string"), queries, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(doc_id#\d+L?, (\d+)\)", plan)]
    # 90 x 30 pairs and 90 x 2 postings.
    assert tasks == [-(-(2700 + 180) // 100)] and "REPARTITION_BY_NUM" in plan
    got = rows(hits, "query_id", "doc_id", "score", "rank")
    want = plain_bm25(data, asked, 3)
    assert [g[:2] + g[3:] for g in sorted(got)] == [w[:2] + w[3:] for w in want]


def plain_topk(vectors, queries, k):
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    out = []
    for q, qv in queries:
        scored = sorted((-round(float(unit(qv) @ unit(v)) + 0.0, 6), d) for d, v in vectors)
        out += [(q, d, -s + 0.0, r) for r, (s, d) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vector_data():
    rng = np.random.default_rng(5)
    vectors = [(n, rng.normal(size=8).round(3)) for n in range(40)]
    vectors += [(40, np.zeros(8)), (41, vectors[3][1]), (42, vectors[3][1] * 2), (43, -vectors[3][1])]
    return vectors


@pytest.fixture(scope="module")
def vectors(spark, vector_data):
    return spark.createDataFrame(
        [(n, [float(x) for x in v], n % 3) for n, v in vector_data], "doc_id long, embedding array<double>, label int"
    ).repartition(4)


@pytest.mark.parametrize("limits", [SizeLimits(), TINY])
def test_t1_exact_topk(vectors, vector_data, rows, limits):
    asked = vectors.select(F.col("doc_id").alias("query_id"), "embedding")
    for k in (1, 4, 100):
        got = rows(nearest(vectors, asked, k, limits=limits), "query_id", "doc_id", "score", "rank")
        want = plain_topk(vector_data, vector_data, k)
        assert sorted(g[:2] + g[3:] for g in got) == sorted(w[:2] + w[3:] for w in want)
        assert [g[2] for g in sorted(got)] == pytest.approx([w[2] for w in sorted(want)], abs=2e-6)


def test_topk_is_a_prefix_and_filters(vectors, rows, vector_data):
    asked = vectors.select(F.col("doc_id").alias("query_id"), "embedding")
    four = rows(nearest(vectors, asked, 4).filter("rank <= 3"))
    assert four == rows(nearest(vectors, asked, 3))
    filtered = nearest(vectors, asked, 50, where={"label": 1}).groupBy("query_id").count()
    expected = sum(1 for n, _ in vector_data if n % 3 == 1)
    assert {r["count"] for r in filtered.collect()} == {expected}
    post = nearest_post_filtered(vectors, asked, 5, {"label": 1}).groupBy("query_id").agg(F.max("rank").alias("n"))
    assert all(r["n"] <= 5 for r in post.collect())
    plan = nearest(vectors, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pairs_of_blocks_are_pruned(spark, rows):
    """On clustered vectors most pairs of blocks never meet, and the hits are those of all pairs."""
    rng = np.random.default_rng(8)
    centres = np.eye(24)[:12]
    data = [(n, [float(x) for x in centres[n % 12] + rng.normal(size=24) * 0.05]) for n in range(960)]
    v = spark.createDataFrame(data, "doc_id long, embedding array<double>").repartition(4)
    q = v.selectExpr("doc_id AS query_id", "embedding")
    log = {}
    found = best_first(nearest_module._blocks(v, q, 5, 6, 40, log), 5)
    assert rows(found, "query_id", "doc_id", "rank") == rows(nearest(v, q, 5), "query_id", "doc_id", "rank")
    assert log["first"] + log["second"] < 0.3 * log["all"]
    # One block that holds nearly everything is split, and k beyond all vectors gives all.
    same = spark.createDataFrame([(n, [1.0, 0.0] if n else [0.0, 1.0]) for n in range(50)], "doc_id long, embedding array<double>")
    assert best_first(nearest_module._blocks(same, same.selectExpr("doc_id AS query_id", "embedding"), 99, 6, 10), 99).count() == 2500
    zeros = spark.createDataFrame([(n, [0.0, 0.0]) for n in range(4)], "doc_id long, embedding array<double>")
    assert rows(nearest(zeros, zeros.selectExpr("doc_id AS query_id", "embedding"), 2, limits=TINY), "query_id", "doc_id") == [(q, d) for q in range(4) for d in (0, 1)]
    assert nearest(v.limit(0), q, 2, limits=TINY).count() == nearest(v, q.limit(0), 2, limits=TINY).count() == 0


def test_text_ids(spark, rows):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("ä", [1.0, 0.0])], "doc_id string, embedding array<float>")
    q = v.selectExpr("doc_id AS query_id", "embedding")
    want = [("a", "a", 1.0, 1), ("a", "ä", 1.0, 2), ("b", "a", 0.0, 2), ("b", "b", 1.0, 1), ("ä", "a", 1.0, 1), ("ä", "ä", 1.0, 2)]
    for limits in (SizeLimits(), TINY):
        assert rows(nearest(v, q, 2, limits=limits), "query_id", "doc_id", "score", "rank") == sorted(want, key=repr)


def test_p28_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<float>")
    assert [r[0] for r in normalise(df, "embedding").collect()] == [[0.6, 0.8], [0.0, 0.0]]


@pytest.mark.parametrize("kind", ["planes", "centroids"])
def test_t2_cells(vectors, rows, kind):
    asked = vectors.select(F.col("doc_id").alias("query_id"), "embedding")
    cells = PlaneCells(8, 2) if kind == "planes" else train_cells(vectors, 4)
    celled = assign_cells(vectors, cells)
    some = nearest_approximate(celled, asked, 3, cells, probes=2)
    assert rows(some) == rows(nearest_approximate(celled, asked, 3, cells, probes=2, limits=TINY))
    probed_all = nearest_approximate(celled, asked, 3, cells, probes=4 if kind == "centroids" else 3)
    exact = nearest(vectors, asked, 3)
    if kind == "centroids":
        assert rows(probed_all) == rows(exact)
    recall = recall_at_k(some, exact).agg(F.avg("recall")).first()[0]
    assert 0 < recall <= 1


def test_t2_recall_with_fewer_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    data = [(n, [float(x) for x in centres[n % 12] + rng.normal(size=16)]) for n in range(600)]
    v = spark.createDataFrame(data, "doc_id long, embedding array<float>").repartition(4)
    q = v.selectExpr("doc_id AS query_id", "embedding")
    cells = train_cells(v, 12)
    assert isinstance(cells, CentroidCells)
    celled = assign_cells(v, cells).cache()
    found = nearest_approximate(celled, q, 10, cells, probes=3)
    assert recall_at_k(found, nearest(v, q, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    sizes = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}
    assert sum(sorted(sizes.values())[-3:]) < 600


def test_m1_embedding(spark, rows):
    data = [(n, f"word{n} common word{n % 3}") for n in range(1200)] + [(1200, None), (1201, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: np.array(r["embedding"]) for r in embed(df, HashedEncoder(32), batch_rows=100).collect()}
    assert len(got) == 1202 and not got[1200].any() and not got[1201].any()
    encoder = HashedEncoder(32)
    for n, text in data[:50]:
        assert got[n] == pytest.approx(encoder.encode([text])[0], abs=1e-6)
        assert np.linalg.norm(got[n]) == pytest.approx(1, abs=1e-6)


def plain_rrf(lists, weights, k=60):
    score, order = {}, []
    for hits, w in zip(lists, weights):
        for rank, d in enumerate(hits, 1):
            if d not in score:
                order.append(d)
            score[d] = score.get(d, 0) + w / (k + rank)
    return sorted(order, key=lambda d: -round(score[d], 9))


def test_t4_fusion(spark):
    cases = {0: (["a", "b", "c"], ["c", "d"]), 1: (["a"], []), 2: ([], ["x", "y"]), 3: (["a", "b", "a"], ["b"]), 4: (["p", "q"], ["q", "p"])}
    def table(side):
        return spark.createDataFrame(
            [(q, d, 0.0, r) for q, pair in cases.items() for r, d in enumerate(pair[side], 1)],
            "query_id long, doc_id string, score double, rank int").repartition(3)
    for weights in ([1.0, 0.4], None):
        got = {}
        for r in fuse([table(0), table(1)], weights).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == {q: plain_rrf(pair, weights or [1, 1]) for q, pair in cases.items()}
    assert fuse([table(0)], top_k=2).filter("rank > 2").count() == 0
    with pytest.raises(ValueError):
        fuse([table(0)], [1.0, 2.0])


def test_t5_rerank_cut(spark):
    rows = [(0, d, r, s) for d, r, s in (("a", 1, -2.0), ("b", 2, 0.5), ("c", 3, 0.5), ("d", 4, -3.0))]
    rows += [(1, "a", 1, None), (1, "b", 2, None)]
    df = spark.createDataFrame(rows, "query_id long, doc_id string, rank int, rerank_score double")
    flags = {(r["query_id"], r["needs_rerank"]) for r in split_by_need(df, 2).collect()}
    assert flags == {(0, True), (1, False)}
    kept = {(r["query_id"], r["rank"]): r["doc_id"] for r in cut(df, 3).collect()}
    assert kept == {(0, 1): "b", (0, 2): "c", (0, 3): "a", (1, 1): "a", (1, 2): "b"}
    scores = {r["query_id"]: tuple(r)[1:] for r in query_scores(cut(df, 2)).collect()}
    assert scores == {0: (0.5, 0.5, 2), 1: (1.0, 1.0, 2)}


def test_l3_hybrid_options(spark, docs, queries):
    index = index_of(docs.withColumn("meta_kind", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")), HashedEncoder(32))
    result = {r["query_id"]: r for r in retrieve(queries, index).collect()}
    assert len(result) == len(QUERIES)
    assert [d["doc_id"] for d in result[0]["docs"]][:1] != [] and result[0]["confidence"] == "high"
    assert len(result[4]["docs"]) == 5      # vectors still return neighbours without any token
    filtered = hybrid_hits(queries, index, where={"kind": "even"})
    assert all(r["doc_id"] % 2 == 0 for r in filtered.collect())
    leaky = candidate_list(queries, index, where={"kind": "even"}, filter_lexical=False)
    assert any(r["doc_id"] % 2 for r in leaky.collect())
    plain = hybrid_hits(queries, index, RetrievalConfig(rerank=False, hybrid=False, top_k=2))
    assert {r["rank"] for r in plain.collect()} == {1, 2} and plain.filter("rerank_score is not null").count() == 0
    few = retrieve(queries, index, RetrievalConfig(top_k=8))      # as many candidates as documents: no rerank
    assert {(r["best_score"], r["confidence"]) for r in few.collect()} == {(1.0, "high")}


def test_l3_pair_model_runs_only_when_needed(spark, docs, queries):
    index = index_of(docs, HashedEncoder(32))
    def model(asked, texts):
        return [float(len(t)) for t in texts]
    top = hybrid_hits(queries, index, RetrievalConfig(top_k=1), pair_model=model).collect()
    assert all(r["rerank_score"] == max(len(t) for _, t in DOCS) for r in top)
    skipped = hybrid_hits(queries, index, RetrievalConfig(top_k=8), pair_model=lambda a, b: 1 / 0)
    assert skipped.filter("rerank_score is not null").count() == 0


def test_l2_stored_index(spark, tmp_path, rows):
    records = spark.createDataFrame(
        [(str(n), f"Name{n}", f"description number {n} about topic{n % 4}", "ind", "t", "US", 2000 + n, "YC", n % 5 == 0, n)
         for n in range(60)],
        "startup_id string, name string, description string, industry string, tags string, country string, founded_year int, source string, is_suspicious boolean, ordinal int",
    ).repartition(5)
    path = str(tmp_path / "index")
    assert build_index(records, path, encoder=HashedEncoder(32)) == 60
    store = IndexStore(spark, path)
    ids = {r["doc_id"]: r["text"] for r in store.documents().collect()}
    assert all(ids[f"doc_{n}"].startswith(f"Name: Name{n}\n") for n in range(60))
    assert build_index(records, path, encoder=HashedEncoder(32), batch="again") == 60     # nothing new
    assert build_index(records, path, encoder=HashedEncoder(32), batch="initial") == 60   # repeat replaces itself
    asked = spark.createDataFrame([(0, "topic3 number 7"), (1, "Name12")], "query_id long, text string")
    stored = hybrid_hits(asked, open_index(spark, path, HashedEncoder(32)))
    direct = hybrid_hits(asked, index_of(store.documents(), HashedEncoder(32)))
    assert rows(stored, "query_id", "rank", "doc_id") == rows(direct, "query_id", "rank", "doc_id")
    suspicious = hybrid_hits(asked, open_index(spark, path, HashedEncoder(32)), where={"is_suspicious": "True"})
    assert all(int(r["doc_id"][4:]) % 5 == 0 for r in suspicious.collect())
    plan = store.vectors().filter("meta_source = 'YC'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(meta_source), EqualTo(meta_source,YC)]" in plan and "embedding" not in plan
    assert build_index(records, path, encoder=HashedEncoder(32), limit=7, reset=True) == 7


def test_stored_index_reads_only_wanted_shards(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr("lodesift.sources.store.SHARD_BYTES", 500)
    docs = spark.createDataFrame([(f"d{n}", f"term{n} shared") for n in range(100)], "doc_id string, text string")
    store = IndexStore(spark, str(tmp_path / "index"))
    store.append(docs, "one", HashedEncoder(16))
    assert store.shards()[0] > 5
    index = open_index(spark, store.path, HashedEncoder(16))
    asked = spark.createDataFrame([(0, "term7")], "query_id long, text string")
    hits = hybrid_hits(asked, index)
    assert rows(hits, "query_id", "rank", "doc_id") == rows(hybrid_hits(asked, index_of(docs, HashedEncoder(16))), "query_id", "rank", "doc_id")
    assert hits.orderBy("rank").first()["doc_id"] == "d7"
    wanted = index.postings(spark.createDataFrame([("term7",)], "term string"))
    for df in (hits, wanted):       # folders of documents and of postings
        assert "dynamicpruning#" in df._jdf.queryExecution().executedPlan().toString()


def test_failed_batch_stays_unseen(spark, tmp_path, rows, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "index"))
    first = spark.createDataFrame([(f"d{n}", f"term{n} shared") for n in range(20)], "doc_id string, text string")
    store.append(first, "one", HashedEncoder(16))
    second = spark.createDataFrame([(f"e{n}", f"term{n} shared") for n in range(30)] + [("d3", "other")], "doc_id string, text string")
    write = IndexStore._write

    def dying(self, df, name, *rest):
        if name == "documents":
            raise RuntimeError("lost")
        write(self, df, name, *rest)

    monkeypatch.setattr(IndexStore, "_write", dying)
    with pytest.raises(RuntimeError):
        store.append(second, "two", HashedEncoder(16))
    monkeypatch.setattr(IndexStore, "_write", write)
    assert store.count() == store.vectors().count() == 20
    store.append(second, "three", HashedEncoder(16))
    df = {r["term"]: r["df"] for r in store.terms().collect()}
    assert (store.count(), store.vectors().count(), df["shared"], df["term7"]) == (50, 50, 50, 2)
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x", "a b"), ("x", "c d")], "doc_id string, text string"), "four", HashedEncoder(16))
    with pytest.raises(ValueError):
        store.append(first, "1", HashedEncoder(16))


def test_shards_follow_each_batch(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr("lodesift.sources.store.SHARD_BYTES", 2000)
    monkeypatch.setattr("lodesift.operators.blocks.CHUNK_DOCS", 10)
    docs = [(f"d{n}", f"term{n} word{n % 9} shared") for n in range(80)]
    store = IndexStore(spark, str(tmp_path / "index"))
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for label, part in (("one", docs[:3]), ("two", docs[3:])):
            store.append(spark.createDataFrame(part, "doc_id string, text string"), label, HashedEncoder(16))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert store.shards()[0] == 1 and store.shards()[-1] >= 4
    hot = list((tmp_path / "index" / "postings" / "batch=two").glob("shards=*/shard=*/*.parquet"))
    assert len(hot) > store.shards()[-1]       # a folder that is too much for one task has several files
    asked = spark.createDataFrame([(0, "term1 shared"), (1, "word3 term50")], "query_id long, text string")
    whole = index_of(spark.createDataFrame(docs, "doc_id string, text string"), HashedEncoder(16))
    stored = open_index(spark, store.path, HashedEncoder(16))
    want = rows(hybrid_hits(asked, whole), "query_id", "rank", "doc_id")
    assert rows(hybrid_hits(asked, stored), "query_id", "rank", "doc_id") == want
    tight = SizeLimits(broadcast_bytes=1)
    assert rows(hybrid_hits(asked, stored, limits=tight), "query_id", "rank", "doc_id") == want


def corpus_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{min(int(rng.expovariate(0.05)), 400)}" for _ in range(rng.choice([0, 3, 30, 90])))) for i in range(n)]


@pytest.mark.parametrize("settings, limits", [({}, SizeLimits()), ({"BLOCK": 4, "CHUNK_DOCS": 30}, SizeLimits()), ({"BLOCK": 4, "CHUNK_BYTES": 900}, SizeLimits(broadcast_bytes=3000))])
def test_block_search_equals_all_scores(spark, rows, monkeypatch, settings, limits):
    for name, value in settings.items():
        monkeypatch.setattr(blocks, name, value)
    data = [*corpus_of(300), (900, None), (901, "Éa ﬁ w1w1 \u212aelvin"), (902, "w3 " * 2000)]
    asked = [(q, text) for q, text in corpus_of(40, 2)] + [(100, None), (101, "kelvin elvin"), (102, "w3 w3")]
    df = spark.createDataFrame([(*d, d[0] % 3) for d in data], "doc_id long, text string, meta_kind int").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = rows(blocks.block_search(df, queries, 7, limits=limits), "query_id", "doc_id", "score", "rank")
    want = plain_bm25([(d, t or "") for d, t in data], [(q, t or "") for q, t in asked], 7)
    assert [g[:2] + g[3:] for g in sorted(got)] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in sorted(got)] == pytest.approx([w[2] for w in want], abs=1e-6)
    filtered = blocks.block_search(df, queries, 7, limits=limits, where={"kind": 1}).collect()
    full = {(r["query_id"], r["doc_id"]): r["score"] for r in blocks.block_search(df, queries, 1000).collect()}
    best = {}
    for (q, d), s in full.items():
        if d % 3 == 1:
            best.setdefault(q, []).append((-s, d))
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in filtered} == {(q, n, d) for q, x in best.items() for n, (_, d) in enumerate(sorted(x)[:7], 1)}
    with pytest.raises(ValueError):
        blocks.block_search(df, queries, 7, where={"colour": 1})


def test_blocks_out_of_reach_stay_closed(spark, monkeypatch):
    """Documents about few topics each, side by side: a question's threshold closes most blocks."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    data = [(n, f"shared topic{n // 8} " + f"word{n // 8}x{n % 3} " * (n % 5)) for n in range(640)]
    packed = materialise(blocks.packed_postings(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).withColumn("batch", F.lit("")))
    terms = materialise(blocks.packed_terms(packed))
    queries = spark.createDataFrame([(q, f"shared topic{q} word{q}x1") for q in range(20)], "query_id long, text string")
    search = blocks.BlockSearch(
        lambda wanted, few: packed.join(wanted, "term", "left_semi"), blocks.chunk_rows(packed), queries, terms, read_corpus(corpus_statistics(terms)), 3)
    opened, held = search.opened()
    assert 0 < opened <= 0.1 * held
    got = sorted((r["query_id"], r["doc_id"], r["rank"]) for r in search.hits().collect())
    assert got == [(q, d, n) for q, d, _, n in plain_bm25(data, [(q, f"shared topic{q} word{q}x1") for q in range(20)], 3)]


def test_merged_batches(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr("lodesift.sources.store.CHUNK_DOCS", 40)
    data = [(f"d{n}", text, f"k{n % 2}") for n, text in corpus_of(120)]
    schema = "doc_id string, text string, meta_kind string"
    queries = spark.createDataFrame(corpus_of(8, 5), "query_id long, text string")
    store, encoder = IndexStore(spark, str(tmp_path / "index")), HashedEncoder(16)
    for n in range(5):
        part = data[max(0, n * 24 - 4):n * 24 + 24]     # batches overlap
        store.append(spark.createDataFrame(part, schema), f"b{n}", encoder)
        if n == 3:
            early = open_index(spark, store.path, encoder)
            before = rows(hybrid_hits(queries, early), "query_id", "rank", "doc_id")
            made = store.compact()
            assert len(made) == 1 and [r["label"] for r in store.batches().collect()] == made
            # A reader from before the merge answers as it did, and so does one from after it.
            assert rows(hybrid_hits(queries, early), "query_id", "rank", "doc_id") == before
            assert rows(hybrid_hits(queries, open_index(spark, store.path, encoder)), "query_id", "rank", "doc_id") == before
            store.append(spark.createDataFrame(data[:24], schema), "b0", encoder)       # repeated after its merge
            assert store.count() == 96
    assert store.count() == store.documents().count() == store.vectors().count() == 120
    whole = index_of(spark.createDataFrame(data, schema), encoder)
    merged = open_index(spark, store.path, encoder)
    for where in (None, {"kind": "k1"}):
        assert rows(hybrid_hits(queries, merged, where=where), "query_id", "rank", "doc_id") == rows(hybrid_hits(queries, whole, where=where), "query_id", "rank", "doc_id")
    assert merged.corpus.__dict__ == pytest.approx(whole.corpus.__dict__)
    plan = store.snapshot().terms()._jdf.queryExecution().executedPlan().toString()
    assert store.merge([r["label"] for r in store.batches().collect()]) and "HashAggregate" in plan
    now = store.snapshot()
    assert len(now.labels) == 1 and "HashAggregate" not in now.terms()._jdf.queryExecution().executedPlan().toString()
    bags = Counter((d, t) for d, text, _ in data for t in tok(text))
    assert {(r["doc_id"], r["term"]): r["tf"] for r in store.postings().collect()} == dict(bags)
    assert len(store.vacuum()) == 6 and store.postings().count() == len(bags)


def test_posting_rows_are_merged_without_lists(spark, tmp_path):
    """Null lists beside posting rows take a time that grows with the square of the rows of an Arrow batch."""
    store = IndexStore(spark, str(tmp_path / "index"))
    for n in range(2):
        store.append(spark.createDataFrame([(f"d{n}{i}", text, "x") for i, text in corpus_of(20)], "doc_id string, text string, meta_kind string"), f"b{n}", HashedEncoder(16))
    merged = store._merged_chunks(store.snapshot())
    sides = [side.schema().simpleString() for side in (lambda c: [c.apply(n) for n in range(c.size())])(merged._jdf.queryExecution().analyzed().children())]
    postings = [side for side in sides if "term:string" in side]
    assert len(postings) == 1 and "array<" not in postings[0]
    heads = merged.filter("term is null").collect()
    assert [h["n"] for h in heads] == [40] and sorted(heads[0]["ids"]) == sorted(f"d{n}{i}" for n in range(2) for i in range(20))
    bags = Counter(t for n in range(2) for _, text in corpus_of(20) for t in set(tok(text)))
    assert {r["term"]: r["n"] for r in merged.filter("term is not null").collect()} == dict(bags)


def test_stored_cells_are_pruned(vectors, rows, spark, tmp_path):
    asked = vectors.filter("doc_id = 1").select(F.col("doc_id").alias("query_id"), "embedding")
    cells = PlaneCells(8, 3)
    celled = assign_cells(vectors, cells)
    write_cells(celled, str(tmp_path / "cells"), file_rows=3)
    stored = read_cells(spark, str(tmp_path / "cells"))
    found = nearest_approximate(stored, asked, 3, cells, probes=2)
    assert rows(found) == rows(nearest_approximate(celled, asked, 3, cells, probes=2))


def test_sizes(spark):
    df = spark.createDataFrame([("abc", [1.0, 2.0]), (None, None)], "t string, v array<double>")
    size = measure(df)
    assert size.rows == 2 and size.bytes > 100
    assert size.blocks(10 ** 9) == 1 and size.blocks(size.bytes) == 2
    for limit, hinted in ((10 ** 6, True), (10, False)):
        plan = broadcast_if_small(df, limit)._jdf.queryExecution().logical().toString()
        assert ("broadcast" in plan.lower()) == hinted


def test_results_do_not_depend_on_partitions(spark, docs, queries, rows):
    one = rows(bm25_search(docs.coalesce(1), queries, 5))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert rows(bm25_search(docs.repartition(6), queries, 5)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert LexicalConfig().k1 == 1.5


def test_rows_are_sent_to_stripes_not_to_blocks(spark, rows, monkeypatch):
    """Without clusters nearly every block meets every other; what is sent grows with the rows all the same."""
    rng = np.random.default_rng(12)
    sent = []
    whole = nearest_module._sent
    monkeypatch.setattr(nearest_module, "_sent", lambda *a: (sent.append(d := whole(*a)), d)[1])
    data = [(n, [float(x) for x in rng.normal(size=16)]) for n in range(1200)]
    v = spark.createDataFrame(data, "doc_id long, embedding array<double>").repartition(4)
    q = v.selectExpr("doc_id AS query_id", "embedding")
    log = {}
    found = rows(best_first(nearest_module._blocks(v, q, 5, 6, 20, log), 5), "query_id", "doc_id", "rank")
    assert found == rows(nearest(v, q, 5), "query_id", "doc_id", "rank")
    assert log["all"] == 60 * 60 and log["second"] > 0.5 * log["all"]
    to_vectors, to_queries = nearest_module.V_STRIPES, nearest_module.Q_STRIPES
    assert [d.count() for d in sent[-2:]] == [1200 * to_queries, 1200 * to_vectors]


def test_tokens_take_a_few_bytes_for_each_byte_of_text():
    """Tokens of texts that touch stay apart, single letters go, and no number is held for every byte."""
    import tracemalloc

    import pyarrow as pa

    from lodesift.operators import blocks

    codes, terms, counts = blocks._tokens(pa.array(["ab", "cd e", "", "f gh", "x", "yz9 ab"]))
    assert [terms[c].as_py() for c in codes] == ["ab", "cd", "gh", "yz9", "ab"] and counts.tolist() == [1, 1, 0, 1, 0, 2]
    texts = pa.array(["incomprehensibilities unquestionably " * 50_000])
    tracemalloc.start()
    blocks._tokens(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(texts[0].as_py())
