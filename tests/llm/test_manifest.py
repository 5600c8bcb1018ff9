"""Merkle manifests against a plain tree, appends against one build."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodesift.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, root string, key string, block int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """(root, witness of every node) of a list of digests."""
    steps, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, w in enumerate(where):
            begin = w // 16 * 16
            run = nodes[begin:begin + 16]
            steps[i].append((run[:w - begin], run[w - begin + 1:]))
        nodes, where = [sha("".join(nodes[n:n + 16])) for n in range(0, len(nodes), 16)], [w // 16 for w in where]
    return nodes[0], steps


def brute(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    subs, out = [], []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        ordered = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append((ordered, *tree([leaf(r) for r in ordered])))
    root, tops = tree([s[1] for s in subs])
    for (ordered, sub, steps), top in zip(subs, tops):
        for row, own in zip(ordered, steps):
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            folded = leaf(now)
            for left, right in own + top:
                folded = sha("".join(left) + folded + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in own + top))
            out.append((row[0], leaf(row), sub, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def documents(n, rng):
    rows = [(i, rng.choice([None, "a", "b", "B", "é", "hot", "hot", "hot"]), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(["Text A", "ß Ünd", "lower", ""]) + str(i % 50)) for i in range(n)]
    return rows + [(n, None, None, None, None), (n + 5, "alone", "en", 0, ""), (n + 6, "", "en", 1, "x" * 100_000 + "Ä")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", "k", 7) for r in rows], SCHEMA).repartition(5)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n", [0, 14, 700])
def test_against_a_plain_tree(spark, n):
    rows = documents(n, random.Random(n))
    rows += [rows[0], rows[0], (None, "a", "en", 1, "no Id"), (None, "a", "en", 1, "no Id")]
    got = manifest.audited(frame(spark, rows), manifest.tampered())
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == brute(rows)


def test_many_blocks(spark, monkeypatch):
    """Blocks of 16 leaves: several rounds of appended block roots."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    rows = [(i, "one" if i % 3 else f"s{i % 61}", "en", 1, f"Text {i}") for i in range(1100)]
    blocks = manifest.build(frame(spark, rows), manifest.tampered())
    got = [tuple(r) for r in manifest.proofs(blocks).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_appends_equal_one_build(spark):
    rng = random.Random(3)
    rows = sorted(documents(1200, rng), key=lambda r: r[0])
    blocks = manifest.build(frame(spark, rows[:5]), manifest.tampered())
    for begin, end in ((5, 300), (300, 301), (301, len(rows))):
        blocks = manifest.extend(blocks, frame(spark, rows[begin:end]), manifest.tampered())
    got = manifest.proofs(blocks)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == brute(rows)
    with pytest.raises(ValueError):
        manifest.extend(blocks, frame(spark, rows[20:21]))


def test_closed_blocks_are_left_alone(spark):
    rows = [(i, "one", "en", 1, f"t{i}") for i in range(600)]
    before = manifest.build(frame(spark, rows[:520]))
    after = manifest.extend(before, frame(spark, rows[520:]))
    full = lambda df: {r["block"]: r["leaves"] for r in df.filter(F.size("ids") == manifest.BLOCK).collect()}
    assert full(before).items() <= full(after).items() and len(full(after)) == 2


def test_empty_table(spark):
    assert manifest.audited(frame(spark, []).limit(0), manifest.tampered()).count() == 0
