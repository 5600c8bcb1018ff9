"""Repeated windows against a plain walk over all of them."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodesift.llm import windows, words


def brute(rows, size):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            key = tuple(words[k:k + size])
            if key in seen:
                gone[k:k + size] = [True] * size
            seen.add(key)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd é Éf gh ij kl mn op qr 漢字 st,".split()) + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (25, 60, 20, 19)]
    rows = []
    for n in range(150):
        words = [word() for _ in range(rng.randrange(0, 60))]
        for p in passages:
            if rng.random() < 0.3:
                at = rng.randrange(len(words) + 1)
                words[at:at] = p
        rows.append((n * 3 % 151, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "x " * 300), (504, "x " * 45), (505, rows[3][1]), (506, rows[3][1])]
    return rows


@pytest.mark.parametrize("chunk, size", [(2 << 20, 4_000_000), (3000, 900)])
def test_against_walk(spark, monkeypatch, chunk, size):
    monkeypatch.setattr(windows, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(windows, "RANGE", size)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_words int, kept string").repartition(3)
    want = brute(rows, 20)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in windows.drop_repeats(docs).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 500


def test_digest_and_ties(spark):
    text = " ".join(f"w{n}" for n in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = windows.digests(docs).collect()
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 1) == [0, 30]
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [30]
    assert {r["kept_sha256"] for r in got if r["doc_id"] == 2} == {hashlib.sha256(b"").hexdigest()}


def test_empty_table(spark):
    assert windows.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merged_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK_BYTES", 3000)
    found = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in found], "doc_id long, text string").repartition(3)
    table = lambda n: windows.drop_repeats(docs).limit(n)
    whole = {r["doc_id"]: tuple(r)[1:] for r in table(500).collect()}
    monkeypatch.setattr(windows, "PIECE", 40)
    assert {r["doc_id"]: tuple(r)[1:] for r in table(500).collect()} == whole == brute(found, 20)
    keys = np.array([3, 3, 3, 9, 2**64 - 1], np.uint64)
    cut = list(windows._pieces([keys, keys[:0], np.full(200, 3, np.uint64)]))
    assert [sum(w.stop - w.start for w in at) for at in cut if any(w.stop > w.start for w in at)] == [204, 1]


def test_texts_are_compressed_between_passes(spark):
    """Rows that the passes read, sort and send are far smaller than their texts."""
    text = " ".join(f"{w} and then" for w in "some words that nobody minds to read twice".split() * 400)
    docs = spark.createDataFrame([(n, f"{n} {text}") for n in range(40)], "doc_id long, text string")
    rows = windows.chunked(docs, 20).collect()
    held = sum(len(x) if isinstance(x, bytes | bytearray) else sum(len(str(y)) for y in x) if isinstance(x, list) else 8 for r in rows for x in r)
    assert held < 0.2 * 40 * len(text)


def peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_chunk_and_of_a_range():
    text = " ".join(["longwordsfilltext"] * 250_000)
    texts = words.texts_of(pa.array([text]))
    found = words.words_of(texts)
    assert peak_mb(lambda: words.word_hashes(texts, found)) < 25        # 4.5 MB of text; 8 bytes for each of them are 36 MB
    rng = np.random.default_rng(1)
    many = [np.sort(rng.integers(0, 2**63, 150_000, dtype=np.uint64)) for _ in range(10)]
    keys = [np.column_stack((k, k)).tobytes() for k in many]
    table = pa.table({
        "chunk": pa.array(range(10)), "place": pa.array([0] * 10, pa.int32()), "keys": pa.array(keys, pa.binary()),
        "owners": pa.array([np.zeros(150_000, np.uint32).tobytes()] * 10, pa.binary()), "ids": pa.array([np.array([n]).tobytes() for n in range(10)], pa.binary()),
    })
    assert peak_mb(lambda: windows._merge_windows(table)) < 45       # 1.5 million windows of 20 bytes


@pytest.mark.parametrize("hash_bytes", [1, 7, 1 << 18])
def test_hashes_do_not_depend_on_slices(monkeypatch, hash_bytes):
    monkeypatch.setattr(words, "HASH_BYTES", hash_bytes)
    texts = words.texts_of(pa.array([t for _, t in corpus()]))
    found = words.words_of(texts)
    seen = {}
    for h, a, b in zip(words.word_hashes(texts, found).tolist(), found.starts, found.ends):
        assert seen.setdefault(bytes(texts.data[a:b]), h) == h
    assert len(set(seen.values())) == len(seen) > 300
    monkeypatch.setattr(words, "HASH_BYTES", 1 << 30)
    assert (words.word_hashes(texts, found) == [seen[bytes(texts.data[a:b])] for a, b in zip(found.starts, found.ends)]).all()
