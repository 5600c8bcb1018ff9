"""Connected components of a table of links, by alternating star contractions.

In each round every node hands its larger neighbours to the smallest node it
knows.  The number of rounds grows with the logarithm of the longest path.  A
node with very many links is a skewed join that adaptive execution splits; the
smallest neighbour is an aggregate with partial sums.  Every round is written to
the shared folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """Rows (u, v) with u > v: neighbours of each node, handed to its smallest one."""
    both = links.select("u", "v")
    if not larger_only:
        both = both.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join below shuffles both sides and can split a node of many links.
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    if larger_only:
        handed = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        handed = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v): the smallest node that can be reached.

    Nodes without a link to another one do not occur; null ends are left out.
    Links may be repeated and have either direction.
    """
    ordered = links.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    now = ordered.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        now = materialise(_star(now, larger_only=False), "links")
        now = materialise(_star(now, larger_only=True), "links")
        # A star forest is a fixed point: same number of links, same sum of their ends.
        state = now.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
