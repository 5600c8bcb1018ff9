"""Exact top-k against all products."""

import math

import numpy as np
import pytest

from lodesift.llm import vafile


def brute(rows, queries, k):
    numbers = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            numbers.setdefault((i, tuple(math.floor(64 * float(x)) for x in v)))
    out = {}
    for q, x in numbers:
        if q in queries:
            found = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in numbers if i != q]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("block, part, broadcast", [(4096, 1024, 32 << 20), (40, 7, 0)])
def test_against_all_products(spark, monkeypatch, block, part, broadcast):
    monkeypatch.setattr(vafile, "BLOCK", block)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", part)
    monkeypatch.setattr(vafile, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(1)
    rows = [(n, rng.normal(size=12).astype(np.float32).tolist()) for n in range(300)]
    rows += [(400, rows[7][1]), (401, rows[7][1]), (402, rows[7][1]), (403, None), (404, [None] * 12), (405, [float("nan")] * 12), (406, [float("inf")] * 12)]
    rows += [(407, [0.0] * 12), (408, [1.0, 2.0]), (409, []), (None, rows[1][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    queries = {n for n in range(0, 500) if n % 20 == 0}
    got = {}
    for r in vafile.topk(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in got.items()} == brute(rows, queries, 20)


def test_fewer_than_k_and_large_values(spark):
    df = spark.createDataFrame([(0, [1e15, 1.0]), (20, [1e15, -1.0]), (3, [-1e15, 2.0])], "vec_id long, embedding array<double>")
    rows = [tuple(r) for r in vafile.topk(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()]
    assert [(r[0], r[1], r[2]) for r in rows] == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert rows[0][3] == 2**63 - 1 and rows[1][3] == -(2**63)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.topk(df, df, 20).count() == 0
