"""Connected components of a graph given as an edge table, by contraction.

Each round every node points to the smallest node among itself and its
neighbours; pointers are followed to their roots, and the edges between
different roots are the graph of the next round. Nothing but counts reaches
the driver, and groups are only ever aggregated or joined, so a node with
very many neighbours is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.session import stage


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component): the smallest node that each node of an edge can reach."""
    edges = stage(_ordered(edges), "edges")
    found = None
    while not edges.isEmpty():
        down = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        tops = edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
        parents = stage(down.union(tops).groupBy("node").agg(F.min("root").alias("root")), "parents")
        while True:
            upper = parents.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            if parents.join(upper, "root").filter("upper <> root").isEmpty():
                break
            parents = stage(parents.join(upper, "root").select("node", F.col("upper").alias("root")), "parents")
        if found is None:
            found = parents
        else:
            moved = parents.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            found = stage(found.join(moved, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "components")
        a = parents.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        b = parents.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        edges = stage(_ordered(edges.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("root").alias("component"))
