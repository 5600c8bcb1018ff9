"""The automaton against plain searching, and merged sketches."""

import random

from pyspark.sql import functions as F

from lodesift.config import SizeLimits
from lodesift.operators import automaton, profile


def plain(text, words):
    return {(w, sum(text.startswith(w, n) for n in range(len(text)))) for w in words if w in text}


def test_walk_equals_plain_search():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé漢") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"\U0001f600a"})
    texts = ["".join(rng.choice("abé漢\U0001f600") for _ in range(rng.choice([0, 1, 7, 60]))) for _ in range(80)]
    a = automaton.build(words)
    row, word = a.walk(texts)
    got = {}
    for r, w in zip(row.tolist(), word.tolist()):
        got[r, words[w]] = got.get((r, words[w]), 0) + 1
    assert got == {(n, w): times for n, t in enumerate(texts) for w, times in plain(t, words)}
    assert len(automaton.build([]).walk(texts)[0]) == 0 and len(a.walk([])[0]) == 0


def test_mentions(spark, rows):
    words = ["a", "ab", "bab", "", None, "zz"]
    texts = [(1, "abab"), (2, None), (3, ""), (4, "xzzzx"), (5, "b" * 20_000 + "ab")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(2)
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((i, w, n) for i, t in texts for w, n in plain(t or "", ["a", "ab", "bab", "zz"]))
    for limits in (SizeLimits(), SizeLimits(broadcast_bytes=4000)):     # one automaton; one for each group of first characters
        assert rows(automaton.mentions(df, "text", listed, limits), "id", "word", "times") == want
    assert automaton.mentions(df, "text", listed.limit(0)).count() == 0


def test_merged_sketches(spark):
    rng = random.Random(5)
    data = [(f"n{rng.randrange(3000)}", rng.choice(["DE", "FR", ""]), f"i{n % 40}", "x" * rng.randrange(500), 1990 + n % 30, n % 7 == 0, n % 5) for n in range(6000)]
    df = spark.createDataFrame(data, "name string, country string, industry string, description string, founded_year int, is_suspicious boolean, batch int")
    states = profile.profile_state(df, "batch")
    assert states.count() == 5 and "description" not in states.columns
    row = profile.merged_profile(states).first()
    names = len({d[0] for d in data})
    assert (row["total"], row["suspicious"], row["countries"], row["industries"]) == (6000, sum(d[5] for d in data), 2, 40)
    assert abs(row["names"] - names) <= 0.03 * names
    lengths = sorted(len(d[3]) for d in data)
    assert lengths[int(0.47 * 6000)] <= row["median_description"] <= lengths[int(0.53 * 6000)]
    assert profile.merged_profile(profile.profile_state(df.filter(F.lit(False)), "batch")).first()["total"] is None
