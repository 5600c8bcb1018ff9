"""The mapped bigram model against the formulas over plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodesift.llm import kneser_ney


def brute(rows):
    """(doc_id, text) -> doc_id: (n_tokens, n_known, N, base, score)."""
    def tokens(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    count, pair = Counter(), Counter()
    for ts in train:
        count.update(ts)
        pair.update(zip(["<s>", *ts], ts))
    total, distinct = sum(count.values()), len(count)
    follow, kinds, before = defaultdict(Counter), Counter(), Counter()
    for (a, b), n in pair.items():
        follow[a][min(n, 3)] += 1
        follow[a]["total"] += n
        before[b] += 1

    def cuts(values):
        n = Counter(values)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * y for k in (1, 2, 3)]
        return [0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))]

    d, low = cuts(pair.values()), cuts(before.values())
    rest = sum(low[min(n, 3)] for n in before.values()) / len(pair) if pair else 1.0

    def chance(a, b):
        lower = max(before[b] - low[min(before[b], 3)], 0) / max(len(pair), 1) + rest / (distinct + 1)
        if not follow[a]["total"]:
            return lower
        left = sum(d[k] * follow[a][k] for k in (1, 2, 3)) / follow[a]["total"]
        return max(pair[a, b] - d[min(pair[a, b], 3)], 0) / follow[a]["total"] + left * lower

    out = {}
    for i, text in rows:
        ts = tokens(text)
        base = sum(math.log10((count[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts)
        out[i] = (len(ts), sum(count[t] > 0 for t in ts), total, base, sum(math.log10(chance(a, b)) for a, b in zip(["<s>", *ts], ts)))
    return out


ROWS = [(n, " ".join(f"W{(n * 7 + k * k) % 13}" for k in range(n % 9))) for n in range(120)] + [
    (200, None), (201, ""), (202, " \t\n"), (203, "the " * 500), (204, "é É the"), (205, "the\vnew"), (206, "unseen words here"),
]


@pytest.mark.parametrize("flush, size", [(4_000_000, 4_000_000), (50, 120)])
def test_scores(spark, monkeypatch, flush, size):
    monkeypatch.setattr(kneser_ney, "FLUSH", flush)
    monkeypatch.setattr(kneser_ney, "RANGE", size)
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in ROWS], "doc_id long, text string, score double, place int")
    want = brute(ROWS)
    got = kneser_ney.scores(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_large_counts(spark):
    docs = spark.createDataFrame([(1, "a " * 70_000), (2, "a b"), (5, "b a")], "doc_id long, text string")
    want = brute([(1, "a " * 70_000), (2, "a b"), (5, "b a")])
    for r in kneser_ney.scores(docs).collect():
        assert math.isclose(r["score"], want[r["doc_id"]][4], rel_tol=1e-9)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert kneser_ney.scores(docs).count() == 0
    model = kneser_ney.fit(docs)
    row = kneser_ney.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert row["n_known"] == 0 and math.isfinite(row["score"])
