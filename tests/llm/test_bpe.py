"""Dynamic-programming encoding against the tokenizers library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodesift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(2)
    parts = ["a", "b", " ", "é", "\n", "\t", "'s", "'LL", "漢", "字", "🙂", "0", "12", "<|endoftext|>", "the", "!!", "ing", "\r\n", " ", "́"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    return [*made, None, "", " ", "a" * 3000, "ab" * 700 + "😀" * 200, " " * 400, "<|endoftext|><|endoftext|>", "\x00\x01", "x" * 255, "x" * 257]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_token_is_its_own_encoding():
    v = bpe.vocabulary(PATH)
    ids, offsets = v.encode_pieces([t for t in v.token if t != b"<|endoftext|>"])
    assert ids.tolist() == [i for i, t in enumerate(v.token) if t != b"<|endoftext|>"] and len(offsets) == len(ids) + 1


def test_against_library(spark, library):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, [9], 1.0) for i, t in rows], "doc_id long, text string, ids array<int>, decoded double").repartition(3)
    done = bpe.encode_texts(docs, PATH, decoded="decoded")
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    got = {r["doc_id"]: r for r in done.collect()}
    for i, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["text"] == text
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False) == (text or "")
    digest = {r["doc_id"]: r for r in bpe.digests(docs, PATH).collect()}
    for i, text in rows:
        assert digest[i]["n_tokens"] == len(got[i]["ids"])
        assert digest[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, got[i]["ids"])).encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_small_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    encoder = bpe.Encoder(PATH)
    for text in texts():
        ids, _ = encoder.encode([text or ""])
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_decoding_of_any_ids(spark, library):
    lists = [[10, 50256, 262], [], [162, 120], [247], None]  # parts of characters become U+FFFD
    docs = spark.createDataFrame(list(enumerate(lists)), "n int, ids array<int>")
    got = {r["n"]: r["text"] for r in bpe.decode_ids(docs, PATH).collect()}
    assert got == {n: library.decode(x or [], skip_special_tokens=False) for n, x in enumerate(lists)}


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
