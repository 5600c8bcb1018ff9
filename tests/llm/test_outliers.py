"""Counts against a plain loop, estimates against plain concentration steps, and what the rule keeps."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lodesift.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    words = WORD.findall(text or "")
    lines = Counter(line for line in (text or "").split("\n") if WORD.search(line))
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(lines.values()) - len(lines), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def sentence(rng, n, stems="river stone green walk table under light seven cloud paper window garden".split()):
    out = []
    for i in range(n):
        word = rng.choice(stems) + rng.choice(["", "s", "ed", "ing", "ly"]) + rng.choice(["", "a", "o"])
        out.append(word.capitalize() if i % 9 == 0 else word + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def junk(rng, n):
    kind = rng.randrange(3)
    words = sentence(rng, n).split()
    if kind == 0:
        return " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in words)
    return " ".join(words).upper().replace(" ", "!! ") if kind == 1 else " | ".join(words)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.1, "k", [1.0]) for r in rows], "doc_id long, text string, lang string, source string, distance double, key string, x array<double>").repartition(5)


def corpus(seed, n):
    rng, rows, bad = random.Random(seed), [], set()
    for i in range(n):
        words = rng.choice([25, 60, 150, 400])
        if rng.random() < 0.12:
            bad.add(i)
        rows.append((i, junk(rng, words) if i in bad else sentence(rng, words), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b"])))
    return rows, bad


def test_counts_and_verdict(spark):
    rows, bad = corpus(3, 2400)
    edges = [None, "", " \n\t", "a", "x" * 100_000, "line one\nline one\nline one\n\n", "é漢 " * 30, ("same eight words again and again and again " * 12), "p q r s t u v w x y z a b c d e f g h i j k " + "1 2 3 4 5 6 7 8 9 " * 2]
    rows += [(5000 + i, t, "en", "hot") for i, t in enumerate(edges)] + [rows[0], rows[0], (None, rows[1][1], "xx", None)]
    got = outliers.quality(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, r
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    judged = {r["doc_id"] for r in got if not r["base_failed"] and r["doc_id"] is not None and r["doc_id"] < 5000}
    assert len(judged & bad & kept) <= 0.02 * len(judged & bad)
    assert len((judged - bad) & kept) >= 0.99 * len(judged - bad)


def brute_estimate(y):
    """Plain concentration steps on one array, from the same three starts, with whole bins of distance."""
    d = y.shape[1]
    floor = np.diag(np.square(list(outliers.FEATURES.values())))
    scale = np.maximum(1.4826 * np.median(np.abs(y), 0), list(outliers.FEATURES.values()))
    z = y / scale

    def white_of(v):
        cov = np.cov(v.T, bias=True)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        alike = cov / spread / spread[:, None]
        np.fill_diagonal(alike, 1)
        return np.linalg.inv(np.linalg.cholesky(scale[:, None] * alike * scale + floor))

    def inside(centre, white):
        bins = outliers.distance_bins(np.square((y - centre) @ white.T).sum(1))
        order = np.sort(bins)
        return bins <= order[int(np.ceil(outliers.H * len(y))) - 1]

    tried = []
    for white in (np.diag(1 / scale), white_of(np.tanh(z)), white_of(z / np.sqrt((z * z).sum(1, keepdims=True) + 1e-18))):
        centre = np.zeros(d)
        for _ in range(outliers.FIRST_STEPS):
            part = y[inside(centre, white)]
            centre, cov = part.mean(0), np.cov(part.T, bias=True)
            white = np.linalg.inv(np.linalg.cholesky(cov + floor))
        tried.append((np.linalg.slogdet(cov + floor)[1], centre, white))
    _, centre, white = min(tried, key=lambda t: t[0])
    for _ in range(outliers.MORE_STEPS):
        part = y[inside(centre, white)]
        centre, cov = part.mean(0), np.cov(part.T, bias=True)
        white = np.linalg.inv(np.linalg.cholesky(cov + floor))
    white = np.linalg.inv(np.linalg.cholesky(cov * outliers.consistency(len(part) / len(y), d) + floor))
    bins = outliers.distance_bins(np.square((y - centre) @ white.T).sum(1))
    part = y[bins <= outliers.distance_bins(np.array([outliers.chi_square_quantile(0.975, d)]))[0]]
    return part.mean(0), np.linalg.inv(np.linalg.cholesky(np.cov(part.T, bias=True) * outliers.consistency(0.975, d) + floor))


def test_estimates_equal_plain_steps(spark):
    rng = np.random.default_rng(4)
    mixing = rng.normal(size=(9, 9)) * 0.2
    groups = {}
    for name in ("a", "b"):
        y = rng.normal(size=(900, 9)) @ mixing
        y[:150] += 6
        groups[name] = np.round(y * 1024) / 1024
    rows = [(k, v.tolist()) for k, y in groups.items() for v in y]
    df = spark.createDataFrame(rows, "key string, y array<double>").repartition(4)
    scale = np.array([np.maximum(1.4826 * np.median(np.abs(groups[k]), 0), list(outliers.FEATURES.values())) for k in ("a", "b")])
    centre, white = outliers.Fit(df, {"a": 0, "b": 1}, np.array([900.0, 900.0])).estimate(scale)
    for n, k in enumerate(("a", "b")):
        want_centre, want_white = brute_estimate(groups[k])
        assert np.allclose(centre[n], want_centre, atol=1e-9) and np.allclose(white[n], want_white, rtol=1e-6, atol=1e-9)
        far = np.square((groups[k] - centre[n]) @ white[n].T).sum(1) > outliers.chi_square_quantile(1 - 1e-4, 9)
        assert far[:150].all() and far[150:].mean() < 0.01


def test_several_rounds_and_small_groups(spark, monkeypatch):
    """Few estimates at a time, and groups too small for one of their own, give what one round gives."""
    rows, _ = corpus(5, 700)
    rows = [(*r[:3], f"s{r[0] % 3}" if r[0] % 40 else f"tiny{r[0]}") for r in rows]
    monkeypatch.setattr(outliers, "LEAST_ROWS", 60)
    one = sorted(tuple(r) for r in outliers.quality(frame(spark, rows)).collect())
    monkeypatch.setattr(outliers, "ESTIMATE_BYTES", 3 * 8 * 90 * 3)
    assert sorted(tuple(r) for r in outliers.quality(frame(spark, rows)).collect()) == one
    assert all(r[7] is not None for r in one)


def test_chi_square():
    assert outliers.chi_square_quantile(0.975, 9) == pytest.approx(19.0228, abs=1e-3)
    assert outliers.chi_square(16.919, 9) == pytest.approx(0.95, abs=1e-4)


def test_few_rows_and_empty(spark):
    few = frame(spark, [(1, sentence(random.Random(1), 40), "en", "a"), (2, "short", "en", "a")])
    assert {(r["doc_id"], r["kept"], r["distance"]) for r in outliers.quality(few).collect()} == {(1, True, None), (2, False, None)}
    assert outliers.quality(few.limit(0)).count() == 0
