"""Snapshots added one by one against one run over all; stored replies."""

import random

import pytest
from pyspark.sql import functions as F

from lodesift.config import STARTUP_COLUMNS, SizeLimits
from lodesift.operators.clean import keep_first
from lodesift.operators.replies import ReplyStore
from lodesift.plans.incremental import IncrementalCatalogue

SCHEMA = "startup_id string, name string, description string, industry string, tags string, country string, founded_year int, source string, ordinal int"


def snapshot(spark, n, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumn("ordinal", F.struct(F.lit(n).alias("snapshot"), F.lit("f").alias("file"), F.col("ordinal").alias("position")))


def records(rng, n, count):
    return [(f"{n}-{i}", rng.choice(["Acme", "ACME", "Bolt", "Ça", f"N{rng.randrange(40)}"]), f"text {n} {i}", "x", "", "", rng.choice([None, 2000, 2001]), rng.choice(["YC", "Crunchbase"]), i) for i in range(count)]


@pytest.mark.parametrize("limits", [SizeLimits(), SizeLimits(broadcast_bytes=0)])
def test_steps_equal_one_run(spark, tmp_path, rows, limits):
    rng = random.Random(2)
    parts = {n: snapshot(spark, n, records(rng, n, 120)) for n in (3, 1, 2)}
    keys = [F.col("source"), F.lower("name"), F.col("founded_year")]
    store, seen, changes = IncrementalCatalogue(spark, str(tmp_path / "all"), limits), None, []
    for n, part in parts.items():
        update = store.add(keep_first(part, keys), f"s{n}")
        changes.append({r["change"]: r["count"] for r in update.groupBy("change").count().collect()})
        seen = part if seen is None else seen.unionByName(part)
        assert rows(store.current(), *STARTUP_COLUMNS) == rows(keep_first(seen, keys), *STARTUP_COLUMNS)
    assert "replaced" not in changes[0] and changes[1]["replaced"] > 0
    store.add(keep_first(parts[2], keys), "s2")         # repeated: replaces itself
    assert rows(store.current(), *STARTUP_COLUMNS) == rows(keep_first(seen, keys), *STARTUP_COLUMNS)


def test_old_rows_are_not_read(spark, tmp_path):
    store = IncrementalCatalogue(spark, str(tmp_path / "all"))
    rng = random.Random(4)
    first, second = (keep_first(snapshot(spark, n, records(rng, n, 30)), [F.lower("name"), F.col("founded_year"), F.col("source")]) for n in (1, 2))
    store.add(first, "a")
    known = store._read("winners", without="b")
    assert set(known.columns) == {"source", "key_name", "key_year", "place", "snapshot"}
    plan = store.add(second, "b")._jdf.queryExecution().executedPlan().toString()
    assert "snapshot=a" not in plan
    with pytest.raises(ValueError):
        IncrementalCatalogue(spark, str(tmp_path / "none")).current()


def test_replies_are_asked_for_once(spark, tmp_path, rows):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    store = ReplyStore(spark, str(tmp_path / "replies"), "v1")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)], "id long, text string")
    one = store.complete(asked, F.col("text"), model, "reply")
    assert {(r["id"], r["reply"]) for r in one.collect()} == {(1, "A"), (2, "B"), (3, "A"), (4, None), (5, None)}
    assert {r["id"] for r in one.filter("reply_error IS NOT NULL").collect()} == {4}
    more = spark.createDataFrame([(6, "b"), (7, "c"), (8, "bad")], "id long, text string")
    two = store.complete(more, F.col("text"), model, "reply")
    assert {(r["id"], r["reply"]) for r in two.collect()} == {(6, "B"), (7, "C"), (8, None)}
    # Distinct prompts of the first run; then the new one, and the failed one again.
    assert [r["prompts"] for r in store.runs().orderBy("run").collect()] == [3, 2]
    other = ReplyStore(spark, str(tmp_path / "replies"), "v2")
    assert other.complete(more.filter("id = 7"), F.col("text"), lambda p: ["x"] * len(p), "reply").first()["reply"] == "x"
