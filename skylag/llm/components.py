"""Connected components of links between integers, without the driver ever seeing a link."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylag.llm.tables import written


def _only_stars(edges: DataFrame) -> bool:
    """Whether every upper node has one edge and no lower node is an upper one: nothing is left to do."""
    ends = edges.selectExpr("hi as node", "1 as up", "0 as low").union(edges.selectExpr("lo as node", "0 as up", "1 as low"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 or (up > 0 and low > 0)").count() == 0


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to one row (node, component) per node that has a link; component is the smallest node reachable.

    Alternates two steps on edges (hi, lo) until they are stars: every node is tied to the smallest of its neighbours, first
    for neighbours above it, then for those below. Each step is an aggregation and a join on the node, both of which
    adaptive execution can split for a node with very many links; the number of steps grows with the logarithm of
    the longest chain. Every round is a written table.
    """
    edges = written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                    .filter("hi <> lo").distinct(), "edges")
    while not _only_stars(edges):
        # Upper neighbours of u, and u itself through its lower ones, go to the smallest node that u sees.
        both = edges.selectExpr("hi as u", "lo as v").union(edges.selectExpr("lo as u", "hi as v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.filter("v > u").join(least, "u").selectExpr("v as hi", "m as lo").distinct()
        # Lower neighbours of u, and u, go to the smallest of them.
        low = up.groupBy("hi").agg(F.min("lo").alias("m"))
        down = (up.join(low, "hi").selectExpr("lo as hi", "m as lo").union(low.selectExpr("hi", "m as lo"))
                .filter("hi <> lo").distinct())
        edges = written(down, "edges")
    return edges.selectExpr("hi as node", "lo as component").union(edges.selectExpr("lo as node", "lo as component")).distinct()
