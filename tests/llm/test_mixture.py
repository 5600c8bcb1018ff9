"""Weights, budgets and permutations against a plain version."""

import math
import random

import pytest

from lodesift.llm import mixture


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows, n = [], 0
    for source, count in (("a", 900), ("b", 200), ("c", 60), (None, 30), ("empty", 4)):
        for _ in range(count):
            rows.append((n, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 40))) if source != "empty" else rng.choice(["", " ", None]), source, -1))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int")


def tokens(rows):
    out = {}
    for r in rows:
        out[r["source"]] = out.get(r["source"], 0) + len((r["text"] or "").split())
    return out


def test_repeats(docs):
    base = tokens(docs.collect())
    most = max(base.values())
    got = mixture.mixed(docs, max_repeats=2.0)
    assert got.columns == ["doc_id", "text", "source", "epoch", "block", "place", "turn"]
    rows = got.collect()
    used = tokens(rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    least = min(n for n in base.values() if n)
    exponent = 1 - math.log(2) / math.log(most / least)
    for source, n in base.items():
        want = n * (most / n) ** (1 - exponent) if n else 0
        assert want - 40 <= used[source] <= want + 1
    for source in base:
        for epoch in {r["epoch"] for r in rows if r["source"] == source}:
            ids = [r["doc_id"] for r in rows if r["source"] == source and r["epoch"] == epoch]
            assert len(ids) == len(set(ids))
    assert all(0 <= r["turn"] <= 1 for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixture.mixed(docs.repartition(7), max_repeats=2.0).collect()))


def test_entropy(docs):
    for goal in (0.8, 0.95, 1.0):
        used = [n for n in tokens(mixture.mixed(docs, entropy=goal).collect()).values() if n]
        shares = [n / sum(used) for n in used]
        found = -sum(p * math.log(p) for p in shares) / math.log(len(shares))
        assert goal - 0.02 <= found <= goal + 0.02 or goal == 0.8 and found >= 0.78


def test_small_blocks(docs, monkeypatch):
    whole = tokens(mixture.mixed(docs, max_repeats=1.5).collect())
    monkeypatch.setattr(mixture, "BLOCK_DOCS", 9)
    monkeypatch.setattr(mixture, "GROUP_BLOCKS", 4)
    small = tokens(mixture.mixed(docs, max_repeats=1.5).collect())
    assert whole.keys() == small.keys() and all(abs(whole[s] - small[s]) <= 40 for s in whole)


def test_edges(spark):
    with pytest.raises(ValueError):
        mixture.bisect(spark.createDataFrame([], "tokens long, share double"))
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture.mixed(none, max_repeats=2.0).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", None)], "doc_id long, text string, source string")
    assert mixture.mixed(blank, max_repeats=2.0).count() == 3
