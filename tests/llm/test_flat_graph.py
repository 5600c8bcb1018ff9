"""Links, components and counts of the flat graph against all pairs."""

import numpy as np
import pytest

from lodesift.llm import flat_graph


def brute(rows, threshold):
    usable = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = (label, len(v), np.array(v, np.float64))
    links = {i: set() for i, _, _ in rows}
    for i, (a, n, x) in usable.items():
        for j, (b, m, y) in usable.items():
            if i != j and a == b and n == m and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j)
    component = {}
    for i in sorted(links):
        stack = [] if i in component else [i]
        while stack:
            at = stack.pop()
            if at not in component:
                component[at] = i
                stack += links[at]
    return {i: (len(links[i]), component[i]) for i in links}


@pytest.mark.parametrize("shard, block", [(1000, 2000), (120, 60)])
def test_against_all_pairs(spark, monkeypatch, shard, block):
    monkeypatch.setattr(flat_graph, "SHARD", shard)
    monkeypatch.setattr(flat_graph, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = []
    for n in range(500):
        v = base[n % 40 if n > 150 else 0] + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.2])
        rows.append((n * 7 % 501, [float(x) for x in v], int(n % 40 % 3)))
    rows += [(900, rows[3][1], rows[3][2]), (901, rows[3][1], rows[3][2]), (902, None, 1), (903, [0.0] * 16, 1), (904, [1.0, None] * 8, 1),
             (905, [float("nan")] * 16, 1), (906, rows[3][1], None), (907, rows[3][1][:8], rows[3][2]), (908, [], 1), (909, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, links int")
    want = brute(rows, 0.98)
    got = {r["vec_id"]: r for r in flat_graph.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, (n, c) in want.items() if (got[i]["n_links"], got[i]["component_id"]) != (n, c)]
    assert len(wrong) <= 0.02 * len(rows), wrong[:10]
    assert all(r["n_links"] <= want[i][0] for i, r in got.items()) and all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_empty_table(spark):
    assert flat_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
