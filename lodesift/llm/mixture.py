"""Mixing sources to target weights by temperature, DataFrame functions only.

A source with the share p of all words gets the weight p ** exponent, divided by
their sum.  The exponent is bisected on a grid of 2 ** -24: the largest one whose
weights have the entropy asked for, or the smallest one that repeats no source
more often than allowed.  The source that is used least is used once as a whole,
so no document is lost.

Each source is permuted anew for every epoch: a hash deals its documents to
blocks and orders them in a block.  Whole epochs take all blocks, the last one
takes documents in that order up to the budget.  Where the budget ends is found
by running sums in blocks, over blocks and over groups of blocks, so no window
holds a whole source; then every document knows its copies where it stands, and
texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from ..operators.sizing import broadcast_if_small

GRID = 1 << 24
#: Exponents tried at once: eight bisections.
FAN = 256
BLOCK_DOCS, GROUP_BLOCKS = 500, 1000
BROADCAST_BYTES = 32 << 20

WORD = r"[^\x20\x09-\x0D]+"


def source_key(source: str) -> Column:
    """A non-null key of a source; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def shares(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(key, docs, tokens, share) of every source; shares are of all words, 0 if there are none."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    found = docs.select(source_key(source).alias("key"), words.alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))
    found = materialise(found, "sources")
    total = found.agg(F.sum("tokens")).first()[0] or 0
    return found.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))


def bisect(sources: DataFrame, max_repeats: float | None = None, entropy: float | None = None) -> float:
    """The exponent, between 0 and 1.

    ``max_repeats`` (1 or more): the smallest one for which no source is used
    more often.  ``entropy`` (0 to 1, of the logarithm of the number of
    sources): the largest one that reaches it, 0 if none does.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give either max_repeats or entropy")
    some = sources.filter("tokens > 0")
    facts = some.agg(F.max("share").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not facts["n"]:
        return 1.0
    low, high = -1, GRID  # a step of the grid that fails, one that holds
    while high - low > 1:
        step = -(-(high - low) // FAN)
        tried = [k for k in range(low + step, high, step)] or [high - 1]
        steps = some.select("share", F.explode(F.array(*map(F.lit, tried))).alias("k"))
        x = F.col("k") / F.lit(float(GRID))
        if max_repeats is not None:
            value = F.max(F.pow(F.lit(facts["most"]) / F.col("share"), 1 - x)) <= max_repeats * (1 + 1e-9)
        else:
            power = F.pow(F.col("share"), 1 - x)
            # Entropy of the weights: log z - sum(p**a * log p**a) / z.
            z = F.sum(power)
            value = F.log(z) - F.sum(power * F.log(power)) / z >= entropy * F.log(F.lit(float(facts["n"]))) - 1e-9
        held = [r["k"] for r in steps.groupBy("k").agg(value.alias("holds")).filter("holds").collect()]  # FAN rows at most
        first = min(held, default=None)
        if first is not None:
            high = first
        low = max((k for k in tried if first is None or k < first), default=low)
    return high / GRID if max_repeats is not None else 1 - high / GRID


def hashed(epoch: Column, doc_id: Column, seed: int) -> Column:
    """60 bits of a hash of a document in an epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _block(place: Column) -> Column:
    return F.pmod(place, F.col("blocks"))


def budgets(docs: DataFrame, max_repeats: float | None, entropy: float | None, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    """A row per source: weight, budget, whole epochs, blocks, and where its last epoch ends."""
    sources = shares(docs, text, source)
    exponent = bisect(sources, max_repeats, entropy)
    facts = sources.agg(F.max("share").alias("most"), F.sum(F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)))).alias("z")).first()
    most, z = facts["most"] or 1.0, facts["z"] or 1.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    repeats = F.when(F.col("share") > 0, F.round(F.pow(F.lit(most) / F.col("share"), F.lit(1 - exponent)), 6)).otherwise(F.lit(1.0))
    plan = sources.withColumn("weight", weight).withColumn("budget", F.floor(F.col("tokens") * repeats))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("int"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS).cast("long"))
    plan = materialise(plan.withColumn("exponent", F.lit(exponent)), "plan")
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    last = docs.select(source_key(source).alias("key"), F.col(doc_id).alias("id"), words.alias("n")).join(broadcast_if_small(plan.filter("rest > 0"), BROADCAST_BYTES), "key")
    last = last.withColumn("place", hashed(F.col("epochs"), F.col("id"), seed)).select("key", "rest", "n", "place", _block(F.col("place")).alias("block"))
    last = materialise(last, "last-epoch")
    blocks = last.groupBy("key", "block").agg(F.sum("n").alias("n")).withColumn("part", F.floor(F.col("block") / GROUP_BLOCKS))
    parts = blocks.groupBy("key", "part").agg(F.sum("n").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over(by[0].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("key", "part", before(Window.partitionBy("key").orderBy("part")).alias("part_before"))
    blocks = blocks.select("key", "part", "block", before(Window.partitionBy("key", "part").orderBy("block")).alias("block_before"))
    offsets = materialise(blocks.join(parts, ["key", "part"]).select("key", "block", (F.col("part_before") + F.col("block_before")).alias("before")), "offsets")
    running = F.sum("n").over(Window.partitionBy("key", "block").orderBy("place"))
    summed = last.withColumn("running", running).join(broadcast_if_small(offsets, BROADCAST_BYTES), ["key", "block"])
    inside = summed.filter(F.col("before") + F.col("running") <= F.col("rest"))
    ends = inside.groupBy("key").agg(F.max(F.struct("block", "place")).alias("end"))
    return plan.join(ends, "key", "left").select("*", F.col("end.block").alias("end_block"), F.col("end.place").alias("end_place")).drop("end")


def mixed(docs: DataFrame, max_repeats: float | None = None, entropy: float | None = None, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs``, each as often as its source's budget says, with epoch, block, place and turn.

    ``block`` and ``place`` order the documents of a source within an epoch.
    ``turn`` lies between 0 and 1 and is equal within a block; sorted by turn,
    the blocks of all sources follow each other in the proportions of the
    weights.  Every document occurs at least once.  A null source is a source of
    its own; sources without words occur once and have no weight; null and empty
    texts count no words.  Rows that are equal in source and id share their
    place, so both or neither are in the last epoch.  Columns of the names added
    are replaced.
    """
    added = ["epoch", "block", "place", "turn"]
    docs = docs.drop(*added)
    plan = materialise(budgets(docs, max_repeats, entropy, seed, doc_id, text, source), "budgets").select(
        F.col("key").alias("_key"), "epochs", "blocks", "rest", "end_block", "end_place", F.col("budget").alias("_budget"), F.col("tokens").alias("_tokens"))
    kept = docs.columns
    rows = docs.withColumn("_key", source_key(source)).join(broadcast_if_small(plan, BROADCAST_BYTES), "_key")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    rows = rows.withColumn("place", hashed(F.col("epoch"), F.col(doc_id), seed)).withColumn("block", _block(F.col("place")))
    in_last = (F.col("block") < F.col("end_block")) | ((F.col("block") == F.col("end_block")) & (F.col("place") <= F.col("end_place")))
    rows = rows.filter((F.col("epoch") < F.col("epochs")) | F.coalesce(in_last, F.lit(False)))
    # Blocks of an epoch are spread evenly over its part of the whole, each a little off its slot.
    span = F.greatest(F.col("_budget") / F.greatest(F.col("_tokens"), F.lit(1)), F.lit(1.0))
    jitter = hashed(F.concat_ws("/", "_key", F.col("epoch").cast("string")), F.col("block"), seed) / F.lit(float(1 << 60))
    turn = F.least((F.col("epoch") + (F.col("block") + jitter) / F.col("blocks")) / span, F.lit(1.0))
    return rows.withColumn("turn", F.round(turn, 6)).select(*kept, *added)
