"""Held-out accuracy, proportions of mixed texts, and the edges."""

import math
import random
import zlib

import numpy as np

from lodesift.llm import language

DATA = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language.predictions(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_labels_are_not_inputs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(language.split(docs))
    plain = language.identify(docs.selectExpr("doc_id", "text"), model)
    masked = language.identify(docs.selectExpr("doc_id", "text", "'xx' AS lang", "1 AS score", "'q' AS lang_pred"), model)
    assert masked.columns == ["doc_id", "text", "lang", "lang_pred", "score", "languages"]
    assert {r["doc_id"]: r["lang_pred"] for r in plain.collect()} == {r["doc_id"]: r["lang_pred"] for r in masked.collect()}


def test_mixture(spark):
    en = "the house and the river with many words of the people that have been in this place when they were young "
    de = "das haus und der fluss mit vielen wörtern der menschen die nicht mehr auf dem land leben wollen und schreiben "
    rows = [(n, en if n % 2 else de, "en" if n % 2 else "de") for n in range(40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, en * 3 + de), (2, de * 5), (3, None), (4, "123 !?"), (5, ""), (6, en)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(asked, model).collect()}
    assert [x["lang"] for x in got[1]["languages"]] == ["en", "de"] and 0.6 < got[1]["score"] < 0.9
    assert (got[2]["lang_pred"], got[6]["lang_pred"]) == ("de", "en") and len(got[2]["languages"]) == 1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5))


def invented(rng, letters, n):
    """Words of a language with a few letters of its own."""
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(n))


TONGUES = {"aa": "aeioubd", "bb": "lmnpqrs", "cc": "tvwxyzk", "dd": "äöüßfgh", "ee": "éèçàjcd", "ff": "ñáíóúgb"}


def plain_shares(text, model):
    """The language set and its shares by loops over words: expectation-maximisation, nested sets, penalised likelihood."""
    words = ["".join(chr(b) for b in w.lower().encode()) for w in text.split()]
    tables = []
    for w in words:
        padded = [32, *map(ord, w), 32]
        grams = [((padded[i] * 65536 + padded[i + 1] * 256 + padded[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(padded) - 2)]
        tables.append([sum(float(model.log_likelihood[k][g]) for g in grams) for k in range(len(model.languages))])

    def mixture(langs, shares):
        for step in range(language.ROUNDS):
            total, sums = 0.0, [0.0] * len(langs)
            for row in tables:
                top = max(row)
                joint = [s * math.exp(row[k] - top) for k, s in zip(langs, shares)]
                mass = max(sum(joint), 1e-30)
                total += math.log(mass) + top
                sums = [a + j / mass for a, j in zip(sums, joint)]
            if step < language.ROUNDS - 1:
                shares = [a / len(tables) for a in sums]
        return shares, total

    every = list(range(len(model.languages)))
    single = [sum(row[k] for row in tables) for k in every]
    best = max(every, key=lambda k: single[k])
    shares, _ = mixture(every, [1 / len(every)] * len(every))
    order = [best, *sorted((k for k in every if k != best), key=lambda k: -shares[k])]
    chosen, value = {best: 1.0}, single[best]
    for size in range(2, len(every) + 1):
        if len(tables) < 2:
            break
        start = [max(shares[k], 1e-3) for k in order[:size]]
        found, total = mixture(order[:size], [s / sum(start) for s in start])
        penalised = total - language.PENALTY * (size - 1) * math.log(len(tables))
        if penalised <= value:
            break
        chosen, value = dict(zip(order[:size], found)), penalised
    return {model.languages[k]: s for k, s in chosen.items()}


def test_sets_of_any_size_equal_plain_inference(spark):
    rng = random.Random(6)
    rows = [(n, invented(rng, letters, 60), lang) for n, (lang, letters) in enumerate(list(TONGUES.items()) * 12)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = []
    for size in (1, 2, 3, 5, 6, 5):
        parts = rng.sample(list(TONGUES), size)
        asked.append((len(asked), " ".join(invented(rng, TONGUES[p], rng.randrange(15, 40)) for p in parts), sorted(parts)))
    asked += [(10, invented(rng, "aeioulmnt", 80), None), (11, "a", None), (12, "x" * 30_000, None)]
    found = language.identify(spark.createDataFrame([a[:2] for a in asked], "doc_id long, text string").repartition(2), model)
    got = {r["doc_id"]: {x["lang"]: x["share"] for x in r["languages"]} for r in found.collect()}
    for n, text, parts in asked:
        want = plain_shares(text, model)
        assert got[n].keys() == want.keys() and np.allclose([got[n][k] for k in want], list(want.values()), atol=5e-3), n
        assert parts is None or sorted(got[n]) == parts
    assert max(map(len, got.values())) == 6


def test_edges(spark):
    rows = [(1, "some plain text", "en"), (1, "some plain text", "en"), (None, "some plain text", "en"), (2, None, "en"), (3, "", None), (4, "7 8 9", "xx"), (5, "word " * 40_000, "en")]
    df = spark.createDataFrame([(*r, 1, ["q"]) for r in rows], "doc_id long, text string, lang string, score int, languages array<string>").repartition(3)
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"]) for r in language.predictions(df).collect()), key=repr)
    assert len(got) == 7 and (None, True, "en") in got and got.count((1, zlib.crc32(b"1") % 3 == 1, "en")) == 2
    assert {g[2] for g in got if g[0] in (2, 3, 4)} == {"und"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.predictions(docs).first()["lang_pred"] == "und"
    assert language.predictions(docs.limit(0)).count() == 0
