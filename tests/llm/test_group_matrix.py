"""Components of the token-group matrix against all pairs of shingle sets."""

import random
import re

import pytest

from lodesift.llm import group_matrix


def shingle_set(text, size=3):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice("ab cd É gh ij kl mn op qr 漢字 st,".split()) + str(rng.randrange(60))
    bases = [[word() for _ in range(n)] for n in (150, 90, 40, 12, 31, 300)]
    rows = []
    for n in range(420):
        words = list(rng.choice(bases[:2] if n % 3 else bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            at = rng.randrange(len(words))
            rng.choice([lambda: words.__setitem__(at, word()), lambda: words.insert(at, word()), lambda: words.pop(at) if len(words) > 1 else None])()
        rows.append((n * 5 % 421, " ".join(words)))
    rows += [(1000 + n, " ".join(word() for _ in range(rng.randrange(1, 60)))) for n in range(80)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "one  two"), (2007, "two one"), (2008, rows[0][1].upper()), (2009, "a " * 500), (2010, "a a a")]
    return rows


@pytest.mark.parametrize("chunk, size, block", [(2 << 20, 4_000_000, 128), (6000, 2000, 7)])
def test_against_all_pairs(spark, monkeypatch, chunk, size, block):
    monkeypatch.setattr(group_matrix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(group_matrix, "RANGE", size)
    monkeypatch.setattr(group_matrix, "BLOCK", block)
    rows = corpus()
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, n int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in group_matrix.jaccard_components(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 100 and max(list(c for _, c in want.values()).count(x) for x in {c for _, c in want.values()}) > 20


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "a b c d"), (5, "other text here now")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in group_matrix.jaccard_components(docs).collect()), key=repr)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (None, 2, None), (3, 2, 3), (5, 2, 5)], key=repr)


def test_empty_table(spark):
    assert group_matrix.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
