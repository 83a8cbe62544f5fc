"""Connected components of an edge table, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.core.storage import saved


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one ordered type -> ``(node, component)``: the least node that each is joined to.

    Each round, every node hands the least of its neighbourhood to its greater neighbours, and then to
    all that it has itself been handed to; edges thus turn into stars around the least nodes, in a
    number of rounds that grows with the logarithm of the longest path.  A node's neighbours are only
    ever reduced to their minimum, so a hub is never gathered; rounds are written to the shared folder.
    Edges with a null end and loops are left out, and so are nodes without any other edge."""
    pair = lambda a, b: [F.greatest(a, b).alias("high"), F.least(a, b).alias("low")]
    now = saved(edges.where("a is not null and b is not null and a <> b").select(*pair("a", "b")).distinct())
    before, mark = None, _mark(now)
    while mark[0] and mark != before:
        each = now.unionByName(now.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = each.groupBy("high").agg(F.min("low").alias("m")).select("high", F.least("high", "m").alias("m"))
        handed = each.where(F.col("low") > F.col("high")).join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low")).where("high <> low").distinct()
        roots = handed.groupBy("high").agg(F.min("low").alias("m"))
        pulled = handed.join(roots, "high").select(F.col("low").alias("x"), "m").union(roots.select(F.col("high").alias("x"), "m"))
        now = saved(pulled.where("x <> m").select(F.col("x").alias("high"), F.col("m").alias("low")).distinct())
        before, mark = mark, _mark(now)
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(now.select("low", "low").distinct())


def _mark(edges: DataFrame) -> tuple:
    """A number of edges and a sum of their hashes: alike if a round changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first())
