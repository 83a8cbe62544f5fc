"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node points its larger neighbours to the least node that it sees."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (
        both.where(F.col("b") > F.col("a"))
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .where("a != b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node points itself and its smaller neighbours to the least of them.  Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).where("a != b").distinct()


def _print_of(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any ordered type -> ``(node, component)``, component being the least node.

    Nodes without an edge to another node are not returned.  Edges with a null end are left out;
    loops, repeated and reversed edges change nothing.  Each round is written to the shared folder;
    a node's neighbours are only ever reduced to their minimum, so a hub is no group in memory.
    The number of rounds grows with the logarithm of the longest chain."""
    now = saved(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = _print_of(now)
    while seen[0]:
        now = saved(_small_star(_large_star(now)))
        then, seen = seen, _print_of(now)
        if then == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
