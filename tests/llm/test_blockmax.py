"""Block-max search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodesift.llm import blockmax

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, words in asked.items():
        found = []
        for i, bag in bags:
            m = 25 + (75 * sum(bag.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * bag[w] // (1000 * bag[w] + 8 * m)) for w in words if bag[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, rng):
    vocabulary = [f"w{j}" for j in range(300)] + ["Größe", "naïve", "漢字", "X9"]
    weights = [1 / (j + 1) for j in range(len(vocabulary))]
    docs = [(i, rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 30, 200])))) for i in range(n)]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 20])))) for j in range(25)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, 0.5, "t") for d in docs], "doc_id long, text string, rank int, score double, term string").repartition(3),
            spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id long"))


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"SHARD_BYTES": 1, "QUERY_BLOCK": 7, "BROADCAST_BYTES": 0}, {"BLOCK": 3, "WINDOW": 50}, {"ASKED_TERMS": 0}])
def test_against_all_scores(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(blockmax, name, value)
    rng = random.Random(5)
    docs, items = corpus(900, rng)
    docs += [docs[3], docs[3], (None, docs[3][1]), (None, None), (7000, None), (7001, ""), (7002, "w5 " * 70_000 + "w250"), (7003, "-- !"), (7004, "x" * 50_000)]
    items += [(100, None), (101, "!!"), (102, "unknownword"), (3, "w250 w250 w251"), (None, "w7 w9"), (103, "W0 w0 w1"), (104, items[2][1])]
    assert rows(blockmax.topk(*frames(spark, docs, items))) == brute(docs, items)


def test_blocks_stay_closed():
    """With a threshold reached, most blocks of the frequent lists are never decompressed."""
    rng = np.random.default_rng(2)
    n = 4000
    frequent, rare = np.arange(n), np.sort(rng.choice(n, 40, replace=False))
    tfs = np.concatenate((np.ones(n, np.int64), np.full(40, 30)))
    lengths = rng.integers(20, 60, n)
    terms = np.concatenate((np.full(n, 5, np.uint64), np.full(40, 9, np.uint64)))
    row = blockmax.pack_shard(np.arange(n), n, lengths, terms, np.concatenate((frequent, rare)), tfs)
    row = {k: np.ascontiguousarray(v, dtype=blockmax._FIELDS[k]).tobytes() if k in blockmax._FIELDS else v for k, v in row.items()}
    shard = blockmax.Shard(row, n, int(lengths.sum()))
    best, plain = blockmax.Heap(10), blockmax.Heap(10)
    asked, weights = np.array([5, 9], np.uint64), np.array([30, 4000])
    shard.search(asked, weights, best)
    shard.open[:] = False
    warm = blockmax.Heap(10)
    warm.least = best.least
    shard.search(asked, weights, warm)
    assert shard.open.mean() < 0.5 and warm.ids.tolist() == best.ids.tolist()
    scores = np.zeros(n, np.int64)
    for t, w in ((0, 30), (1, 4000)):
        at = frequent if t == 0 else rare
        scores[at] += w * blockmax._impact(np.full(len(at), 1 if t == 0 else 30), shard.norm[at])
    plain.offer(scores, np.arange(n), np.zeros(n, bool))
    assert (best.ids.tolist(), best.score.tolist()) == (plain.ids.tolist(), plain.score.tolist())


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert blockmax.topk(docs.limit(0), items).count() == 0
    assert blockmax.topk(docs, items.limit(0)).count() == 0
