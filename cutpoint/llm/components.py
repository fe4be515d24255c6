"""Connected components by alternating large and small stars, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cutpoint.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node of its component.

    Each turn links a node's larger neighbours, then all smaller ones, to its smallest neighbour; nothing
    gathers the neighbours of a node, so a node with many is no burden. Turns are written to the shared
    folder and end when the edges are stars.
    """
    now = settle(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    before = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.expr("CAST(xxhash64(a, b) AS DECIMAL(38, 0))"))).first()
        if size == before:
            return now.selectExpr("a AS node", "b AS label").unionByName(now.selectExpr("b AS node", "b AS label").distinct())
        before = size
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").selectExpr("b AS a", "m AS b").unionByName(low.selectExpr("a", "m AS b"))
        now = settle(small.distinct())
