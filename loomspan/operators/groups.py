"""Connected groups of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomspan.shared import cut


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b) of any type with an order; root is the least node that can be reached.

    Each round a node takes the least root among its neighbours and then that
    root's own (so paths halve), until nothing changes. Rounds are joins and
    minima on the nodes; none collects a neighbourhood.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        nearer = now.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = nearer.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = cut(nearer.join(above, "root", "left").select("node", "old", F.least("root", "top").alias("root")))
        moved = after.filter("root <> old").limit(1).count()
        now = after.select("node", "root")
        if not moved:
            return now
