"""Connected components of a graph of links, with rows that never gather at one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.plans.tables import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for each node of ``links`` (a, b).

    Alternates two rewritings until nothing changes: each node links its larger
    neighbours to its smallest one, then its smaller ones and itself. Links stay
    as many as they were at most, and a chain of n nodes takes about log n rounds.
    Minima are aggregated before they move; a node with very many links is the
    small side of a join that splits its rows.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # Large star: over all neighbours, larger ones go to the smallest.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "star")
        # Small star: over smaller neighbours and oneself.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        moved = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        discard(large, edges)
        edges = after
        if not moved:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
