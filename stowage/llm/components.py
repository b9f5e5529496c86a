"""Connected components of an edge table, without collecting any of it.

Alternates large-star and small-star steps: each node's larger, then smaller,
neighbours are hung onto its least neighbour until the edges are stars around
the least node of each component. Every step aggregates before it joins, so a
node with very many edges is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import discard, keep


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node reachable.

    ``edges`` has columns a and b of one orderable type; loops, nulls, repeats
    and both directions are allowed. An empty table gives no rows.
    """
    spark = edges.sparkSession
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = keep(ordered, "edges")
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        hung = now.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node itself and its smaller neighbours go to the least of them
        lower = hung.groupBy("a").agg(F.min("b").alias("m"))
        small = hung.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, new_path = keep(small.union(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(spark, path)
        path = new_path
        now = new
        # stars: every node that hangs does so once, and nothing hangs on it
        hung_nodes, edges_left = now.agg(F.countDistinct("a"), F.count("*")).first()
        if hung_nodes == edges_left and now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
