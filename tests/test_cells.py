"""Cells with product-quantised codes: plain coding, recall, pruned folders, stored batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodesift.config import RetrievalConfig, SizeLimits
from lodesift.operators import cells, nearest as nearest_module
from lodesift.operators.embed import HashedEncoder
from lodesift.operators.nearest import nearest, recall_at_k
from lodesift.plans.index import open_index
from lodesift.plans.retrieve import hybrid_hits, semantic_list
from lodesift.sources.store import IndexStore


def clustered(n, dim=24, centres=20, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 2
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x):
    return spark.createDataFrame([(n, [float(c) for c in v]) for n, v in enumerate(x)], "doc_id long, embedding array<float>").repartition(4)


def test_codes_equal_plain_loops():
    x = clustered(300)
    codes = cells.fit(x, 10, 5)
    cell = codes.assign(x)
    packed = cells.CellCodes.unpacked(codes.packed())
    assert (packed.assign(x) == cell).all()
    code = codes.encode(x, cell)
    assert code.shape == (300, 5)       # 24 dimensions in groups of five, the last one filled up
    for n in range(0, 300, 37):
        assert cell[n] == min(range(10), key=lambda c: (round(float(((x[n] - codes.centroids[c]) ** 2).sum()), 8), c))
        rest = np.pad(x[n] - codes.centroids[cell[n]], (0, 1)).reshape(5, 5)
        for g in range(5):
            apart = ((codes.entries[g] - rest[g]) ** 2).sum(1)
            assert apart[code[n, g]] == pytest.approx(apart.min(), abs=1e-8)
        whole = np.concatenate([codes.entries[g][code[n, g]] for g in range(5)])[:24] + codes.centroids[cell[n]]
        by_table = x[:3] @ codes.centroids[cell[n]] + codes.tables(x[:3])[:, np.arange(5), code[n]].sum(1)
        assert by_table == pytest.approx(x[:3] @ whole, abs=1e-9)


@pytest.mark.parametrize("limits", [SizeLimits(), SizeLimits(broadcast_bytes=20_000)])
def test_recall_of_stored_cells(spark, tmp_path, rows, limits):
    v = table(spark, clustered(1500))
    asked = v.filter("doc_id % 10 = 0").selectExpr("doc_id AS query_id", "embedding")
    codes = cells.train(v, 1500)
    cells.write_coded(cells.coded(v, codes), str(tmp_path / "cells"), codes)
    stored, codes = cells.read_coded(spark, str(tmp_path / "cells"))
    probes, rescore = cells.calibrated(stored, codes, 10)
    assert probes < codes.cells
    found = cells.nearest_coded(stored, asked, codes, 10, probes=probes, rescore=rescore, limits=limits)
    assert recall_at_k(found, nearest(v, asked, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    assert found.agg(F.max("scored")).first()[0] <= 0.25 * 1500
    # All cells and all vectors: exact.
    whole = cells.nearest_coded(stored, asked, codes, 10, probes=codes.cells, rescore=1500, limits=limits)
    columns = ("query_id", "doc_id", "score", "rank")
    assert rows(whole, *columns) == rows(nearest(v, asked, 10), *columns)


def test_unprobed_folders_are_not_read(spark, tmp_path):
    v = table(spark, clustered(400))
    codes = cells.train(v, 400)
    cells.write_coded(cells.coded(v, codes), str(tmp_path / "cells"), codes)
    stored, codes = cells.read_coded(spark, str(tmp_path / "cells"))
    one = v.filter("doc_id = 7").selectExpr("doc_id AS query_id", "embedding")
    found = cells.nearest_coded(stored, one, codes, 5, probes=2, rescore=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning#" in plan
    assert found.orderBy("rank").first()["doc_id"] == 7 and found.first()["scored"] == 20


def test_written_down_cells_and_few_vectors(spark):
    v = table(spark, clustered(60))
    codes = cells.picked(v, 60)
    assert codes.cells == 8 and codes.entries.shape[1] == 60
    assert len({tuple(c) for c in cells.picked(v.repartition(7), 60).centroids} ^ {tuple(c) for c in codes.centroids}) == 0
    few = table(spark, clustered(1))
    assert cells.train(few, 1).cells == 1
    with pytest.raises(ValueError):
        cells.train(v.limit(0), 0)


def test_stored_index_with_cells(spark, tmp_path, rows):
    docs = [(f"d{n}", f"topic{n % 7} word{n % 31} name{n} shared", f"k{n % 2}") for n in range(240)]
    schema, encoder = "doc_id string, text string, meta_kind string", HashedEncoder(32)
    store = IndexStore(spark, str(tmp_path / "index"))
    for label, part, with_cells in (("one", docs[:100], True), ("two", docs[100:200], True), ("three", docs[200:], False)):
        store.append(spark.createDataFrame(part, schema), label, encoder, cells=with_cells)
    asked = spark.createDataFrame([(n, f"topic{n} word{n} name{n + 30}") for n in range(6)], "query_id long, text string")
    near = RetrievalConfig(approximate=True)

    def recall(index, where=None):
        found = semantic_list(asked, index, 10, where, near)
        assert found.groupBy("query_id").count().filter("count <> 10").count() == 0
        return recall_at_k(found, semantic_list(asked, index, 10, where)).agg(F.avg("recall")).first()[0]

    index = open_index(spark, store.path, encoder)
    assert len(index.coded) == 2 and index.plain_vectors.count() == 40
    assert recall(index) >= 0.9
    filtered = semantic_list(asked, index, 10, {"kind": "k1"}, near)
    assert all(int(r["doc_id"][1:]) % 2 for r in filtered.collect())
    store.merge(["one", "two"])
    merged = open_index(spark, store.path, encoder)
    assert len(merged.coded) == 1 and merged.vectors.count() == 240 and recall(merged) >= 0.9
    assert rows(hybrid_hits(asked, merged), "query_id", "rank", "doc_id") == rows(hybrid_hits(asked, index), "query_id", "rank", "doc_id")


@pytest.mark.parametrize("rescore", [10, 60, 149, 400])
def test_pairs_beyond_the_limit_stay_in_their_tasks(spark, rows, monkeypatch, rescore):
    """The same hits as with a row per pair, also with many equal vectors at the border of what is scored."""
    x = clustered(400)
    x[100:160] = x[7]
    v = table(spark, x)
    codes = cells.train(v, 400)
    stored = cells.materialise(cells.coded(v, codes))
    asked = v.filter("doc_id % 3 = 1").selectExpr("doc_id AS query_id", "embedding")
    columns = ("query_id", "doc_id", "score", "rank", "scored")
    whole = rows(cells.nearest_coded(stored, asked, codes, 5, probes=9, rescore=rescore), *columns)
    monkeypatch.setattr(cells, "_survivors", None)
    limits = SizeLimits(broadcast_bytes=10_000, block_rows=64)
    assert rows(cells.nearest_coded(stored, asked, codes, 5, probes=9, rescore=rescore, limits=limits), *columns) == whole


def test_best_hits_are_decided_without_scoring_every_pair_by_code(spark, rows, monkeypatch):
    """Bins of all scores by code are for queries whose best hits by exact score are mostly not scored."""
    x = clustered(500)
    v = table(spark, x)
    codes = cells.train(v, 500)
    stored = cells.materialise(cells.coded(v, codes))
    asked = v.selectExpr("doc_id AS query_id", "embedding")
    columns = ("query_id", "doc_id", "score", "rank", "scored")
    limits, late = SizeLimits(broadcast_bytes=10_000, block_rows=64), []
    binned = cells._binned
    monkeypatch.setattr(cells, "_binned", lambda rows, left, *a: late.append(left.count()) or binned(rows, left, *a))
    for rescore, few in ((100, 0), (6, 500)):
        whole = rows(cells.nearest_coded(stored, asked, codes, 5, probes=15, rescore=rescore), *columns)
        assert rows(cells.nearest_coded(stored, asked, codes, 5, probes=15, rescore=rescore, limits=limits), *columns) == whole
        assert sum(late) <= few
    assert late and 0 < late[0] < 500


def test_best_of_probed_cells_and_ranks_equal_plain_loops():
    rng = np.random.default_rng(2)
    x = clustered(300)
    x[40:90] = x[3]
    q, cell = x[:70], rng.integers(0, 6, 300)
    probed = rng.random((70, 6)) < 0.6
    probed[5] = False
    best = nearest_module._Best(70, 8, 6)
    for part in np.array_split(np.arange(300), 4):
        best.add(q, np.arange(70), part, x[part], probed, cell[part])
    score = np.round(q @ x.T, 6)
    for n in range(70):
        want = sorted(np.flatnonzero(probed[n][cell]), key=lambda d: (-score[n, d], d))[:8]
        held = best.score[n] > -np.inf
        assert best.doc[n][held].tolist() == want and best.score[n][held] == pytest.approx(score[n, want], abs=1e-12)
    # Any vectors stand for what codes say; equal ones are ranked by id.
    y = np.concatenate([x[:250] + rng.normal(size=(250, 24)) / 20, x[250:]])
    y[120:140] = y[3]
    near, ids = np.round(q @ y.T, 9), rng.permutation(300)
    tried = np.array([rng.choice(300, 9, replace=False) for _ in range(70)])
    tried[:, :4] = [3, 121, 122, 139]
    values, own = np.take_along_axis(near, tried, 1), ids[tried]
    values[7, 6:] = np.nan
    ranks = cells._Ranks(q, values, own)
    for part in np.array_split(np.arange(300), 3):
        ranks.add(y[part], ids[part], cell[part], probed)
    for n in range(70):
        for t in range(9 if n != 7 else 6):
            ahead = (near[n] > values[n, t]) | ((near[n] == values[n, t]) & (ids < own[n, t]))
            assert ranks.counts()[n, t] == np.count_nonzero(ahead & probed[n][cell])
