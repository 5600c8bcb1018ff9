"""Held-out quality on labelled texts, and the edges."""

import random
import zlib

from lodesift.llm import toxicity


def corpus(n):
    rng = random.Random(4)
    word = lambda: rng.choice("river stone green walk table under light seven cloud paper window garden".split()) + rng.choice(["", "s", "ed", "ing"])
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(3, 9)):
                words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "grumbit", "zorkle!!", "Zorkles", "st0pid grumbit"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_quality(spark):
    docs, labels = corpus(1500)
    truth = dict(labels)
    extra = [(5000, None), (5001, ""), (5002, "漢" * 50), (5003, "x" * 100_000), (None, "you idiot")]
    frame = spark.createDataFrame([(*d, 0.5, "a") for d in docs + extra], "doc_id long, text string, score double, features string").repartition(3)
    marks = spark.createDataFrame([*labels, (1, None), (0, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.scores(frame, marks).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    held = [r for i, r in by_id.items() if i in truth and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in by_id.items() if i is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert by_id[5001]["predicted"] == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.scores(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.scores(docs.limit(0), labels).count() == 0
