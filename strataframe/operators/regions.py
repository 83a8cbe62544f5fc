"""Regions of a neighbourhood graph: fusion down to a wanted number, and exchange of members afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.core.components import components
from strataframe.core.storage import saved, with_row_index


def grid_edges(cells: DataFrame, case: str, axes: Sequence[str], node: str) -> DataFrame:
    """(case, a, b) with a < b: nodes of cells that share a face, by equality joins on shifted coordinates."""
    axes = list(axes)
    shift = F.explode(F.sequence(F.lit(0), F.lit(len(axes) - 1)))
    moved = cells.select(F.col(case).alias("case"), F.col(node).alias("p"), shift.alias("along"), *axes)
    moved = moved.select("case", "p", *[(F.col(a) + F.when(F.col("along") == i, 1).otherwise(0)).alias(a) for i, a in enumerate(axes)])
    there = cells.select(F.col(case).alias("case"), F.col(node).alias("q"), *axes)
    return moved.join(there, ["case", *axes]).select("case", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a <> b").distinct()


def _merge_cost(features: Sequence[str]) -> Column:
    """What merging regions a and b adds to the sum of squared deviations from the regions' means."""
    total = F.lit(0.0)
    for f in features:
        gap = F.col(f"{f}_a") / F.col("n_a") - F.col(f"{f}_b") / F.col("n_b")
        total = total + gap * gap
    return F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")) * total


def _sided(regions: DataFrame, features: Sequence[str], side: str) -> DataFrame:
    return regions.select("case", F.col("region").alias(side), F.col("n").alias(f"n_{side}"), *[F.col(f).alias(f"{f}_{side}") for f in features])


def _merges(regions: DataFrame, edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """(case, region, into, edge): one round's merges; ``edge`` is (cost, low, high), by which edges have a total order.

    Every region picks its least edge.  Two that pick the same edge merge into the lesser; a region whose
    pick leads to one of such a pair joins the pair.  As no pair's edge is greater than those of the regions
    that join it, any first part of a case's merges, in order of edges, can be carried out by itself."""
    costs = edges.join(_sided(regions, features, "a"), ["case", "a"]).join(_sided(regions, features, "b"), ["case", "b"])
    costs = costs.select("case", F.struct(_merge_cost(features).alias("cost"), F.col("a").alias("low"), F.col("b").alias("high")).alias("edge"))
    ends = costs.select("case", "edge", F.explode(F.array("edge.low", "edge.high")).alias("region"))
    picks = saved(ends.groupBy("case", "region").agg(F.min("edge").alias("edge")))
    pairs = picks.groupBy("case", "edge").agg(F.count(F.lit(1)).alias("k")).where("k = 2")
    paired = pairs.select("case", F.explode(F.array("edge.low", "edge.high")).alias("other"), F.col("edge.low").alias("into"))
    single = picks.withColumn("other", F.when(F.col("edge.low") == F.col("region"), F.col("edge.high")).otherwise(F.col("edge.low")))
    loose = single.join(paired.select("case", F.col("other").alias("region")), ["case", "region"], "left_anti")
    joining = loose.join(paired, ["case", "other"]).select("case", "region", "into", "edge")
    return pairs.select("case", F.col("edge.high").alias("region"), F.col("edge.low").alias("into"), "edge").unionByName(joining)


def fuse_regions(nodes: DataFrame, edges: DataFrame, features: Sequence[str], target: Column) -> DataFrame:
    """``nodes(case, node, features...)`` and ``edges(case, a, b)`` -> (case, node, region).

    Regions are merged along edges, those first that add least to the squared deviations from the regions'
    means, until a case has ``target`` regions (a column over ``n``, its number of nodes) or no edge is left.
    A constant price for each region would shift all merges alike and so isn't needed.  In each round (see
    ``_merges``) pairs and the stars around them merge; where that's more than a case still needs, its least
    edges count, by places in a range-sorted order, not by a window over the case.  Sizes and sums are
    added, edges are relabelled; all is equality joins and aggregations over regions, whose number falls by
    a part each round, written to the shared folder.  A region is named by one of its nodes.  Nodes
    without an edge stay alone; null ids and features are left out; an empty table gives no rows."""
    features = list(features)
    fine = F.col("case").isNotNull() & F.col("node").isNotNull()
    for f in features:
        fine = fine & F.col(f).isNotNull()
    kept = saved(nodes.where(fine).select("case", "node", *[F.col(f).cast("double").alias(f) for f in features]))
    goals = saved(kept.groupBy("case").agg(F.count(F.lit(1)).alias("n")).select("case", F.greatest(target, F.lit(1)).cast("long").alias("target")))
    regions = kept.select("case", F.col("node").alias("region"), F.lit(1).cast("long").alias("n"), *features)
    ends = kept.select("case", "node")
    edges = edges.select("case", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = edges.join(ends.select("case", F.col("node").alias("a")), ["case", "a"], "left_semi").join(ends.select("case", F.col("node").alias("b")), ["case", "b"], "left_semi")
    rounds: list[DataFrame] = []
    while True:
        left = regions.groupBy("case").agg(F.count(F.lit(1)).alias("k")).join(goals, "case").select("case", (F.col("k") - F.col("target")).alias("excess"))
        left = saved(left.where("excess > 0"))
        edges = saved(edges.join(left, "case", "left_semi").select("case", "a", "b"))
        if edges.isEmpty():
            break
        merges = saved(_merges(regions, edges, features))
        crowded = merges.groupBy("case").agg(F.count(F.lit(1)).alias("k")).join(left, "case").where("k > excess").select("case", "excess")
        crowded = saved(crowded)
        if not crowded.isEmpty():
            ordered = with_row_index(merges.join(crowded, "case"), "case", "edge")
            first = ordered.groupBy("case").agg(F.min("row_index").alias("first"))
            some = ordered.join(first, "case").where(F.col("row_index") - F.col("first") < F.col("excess")).select(*merges.columns)
            merges = saved(merges.join(crowded, "case", "left_anti").unionByName(some))
        renamed = merges.select("case", "region", "into")
        rounds.append(renamed)
        root = F.coalesce("into", "region").alias("region")
        moved = regions.join(renamed, ["case", "region"], "left").select("case", root, "n", *features)
        regions = saved(moved.groupBy("case", "region").agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in features]))
        for side in ("a", "b"):
            to = renamed.select("case", F.col("region").alias(side), "into")
            edges = edges.join(to, ["case", side], "left").withColumn(side, F.coalesce("into", side)).drop("into")
        edges = edges.select("case", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    return _ended(kept, rounds)


def _ended(nodes: DataFrame, rounds: Sequence[DataFrame]) -> DataFrame:
    """(case, node, region): the last region of each node, from each round's (case, region, into).

    Rounds are put together from the last one back, so each is joined at its own, falling, size."""
    final: DataFrame | None = None
    for renamed in reversed(rounds):
        if final is None:
            final = renamed
            continue
        later = final.select("case", F.col("region").alias("into"), F.col("into").alias("last"))
        now = renamed.join(later, ["case", "into"], "left").select("case", "region", F.coalesce("last", "into").alias("into"))
        final = saved(now.unionByName(final))
    if final is None:
        return nodes.select("case", "node", F.col("node").alias("region"))
    ended = nodes.join(final.withColumnRenamed("region", "node"), ["case", "node"], "left")
    return ended.select("case", "node", F.coalesce("into", "node").alias("region"))


def region_means(nodes: DataFrame, members: DataFrame, features: Sequence[str]) -> DataFrame:
    """(case, region, n, features...): the size of each region and the means of its members."""
    means = [F.avg(F.col(f).cast("double")).alias(f) for f in features]
    return nodes.join(members, ["case", "node"]).groupBy("case", "region").agg(F.count(F.lit(1)).alias("n"), *means)


def exchange_members(nodes: DataFrame, members: DataFrame, edges: DataFrame, features: Sequence[str], sweeps: int = 3) -> DataFrame:
    """(case, node, region): members moved to a neighbouring region whose mean is nearer, in at most ``sweeps`` sweeps.

    Means and neighbourhoods of regions are those of ``members`` as given; they're joined to members by
    region, and each member keeps the least of its candidates by a partial minimum, so neither a large
    region nor one with many neighbours is gathered.  Equal distances leave a member where it is, then
    fall to the lesser region.  It ends early once nothing moves."""
    features = list(features)
    means = saved(region_means(nodes, members, features).select("case", "region", *[F.col(f).alias(f"{f}_m") for f in features]))
    own = lambda side: members.select("case", F.col("node").alias(side), F.col("region").alias(f"r{side}"))
    across = edges.select("case", "a", "b").join(own("a"), ["case", "a"]).join(own("b"), ["case", "b"]).where("ra <> rb")
    both = across.select("case", F.col("ra").alias("region"), F.col("rb").alias("other")).union(across.select("case", "rb", "ra"))
    near = saved(both.distinct().unionByName(means.select("case", "region", F.col("region").alias("other"))))
    targets = near.join(means.withColumnRenamed("region", "other"), ["case", "other"])
    total = F.lit(0.0)
    for f in features:
        gap = F.col(f).cast("double") - F.col(f"{f}_m")
        total = total + gap * gap
    rank = F.struct(total.alias("d"), (F.col("other") != F.col("region")).alias("moves"), F.col("other").alias("to"))
    now = saved(members.select("case", "node", "region"))
    values = nodes.select("case", "node", *features)
    for _ in range(sweeps):
        best = now.join(values, ["case", "node"]).join(targets, ["case", "region"]).groupBy("case", "node").agg(F.min(rank).alias("best"))
        new = saved(best.select("case", "node", F.col("best.to").alias("region"), F.col("best.moves").alias("moves")))
        now = new.select("case", "node", "region")
        if new.where("moves").isEmpty():
            break
    return now


def watershed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(case, node, height, marker)``, ``edges(case, a, b)`` -> (case, node, marker): flooding from the marked nodes.

    An edge's pass is the greater height of its ends; passes, and then the ends' ids, put edges in a total order.
    Edges are taken in that order, and each joins what its ends belong to unless both hold a marker already: every
    node so goes to the marker that it reaches over the lowest passes.  Distributed, each basin without a
    marker takes its lowest edge in every round, which is in that forest too, and the basins so joined
    become one; rounds are as many as the logarithm of the longest chain, written to the shared folder, and
    no basin is gathered.  Nodes that no marker reaches get null; nodes with a null height are left out with
    their edges; nodes that share a marker are one basin only where they touch it."""
    kept = saved(nodes.where("case is not null and node is not null and height is not null").select("case", "node", "height", "marker"))
    side = lambda s: kept.select("case", F.col("node").alias(s), F.col("height").alias(f"h{s}"))
    pairs = edges.select("case", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    passes = pairs.join(side("a"), ["case", "a"]).join(side("b"), ["case", "b"])
    now = saved(passes.select("case", "a", "b", F.struct(F.greatest("ha", "hb").alias("pass"), F.col("a").alias("low"), F.col("b").alias("high")).alias("rank")))
    marks = saved(kept.where("marker is not null").select("case", F.col("node").alias("region"), "marker"))
    rounds: list[DataFrame] = []
    while True:
        ends = now.select("case", F.col("a").alias("region"), F.col("b").alias("other"), "rank").union(now.select("case", "b", "a", "rank"))
        loose = ends.join(marks.select("case", "region"), ["case", "region"], "left_anti")
        picks = saved(loose.groupBy("case", "region").agg(F.min(F.struct("rank", "other")).alias("pick")).select("case", "region", "pick.other"))
        if picks.isEmpty():
            break
        node = lambda c: F.struct("case", F.col(c).alias("n"))
        joined = components(picks.select(node("region").alias("a"), node("other").alias("b")))
        renamed = saved(joined.where("node <> component").select(F.col("node.case").alias("case"), F.col("node.n").alias("region"), F.col("component.n").alias("into")))
        rounds.append(renamed)
        moved = marks.join(renamed, ["case", "region"], "left").select("case", F.coalesce("into", "region").alias("region"), "marker")
        marks = saved(moved)
        for s in ("a", "b"):
            now = now.join(renamed.select("case", F.col("region").alias(s), "into"), ["case", s], "left").withColumn(s, F.coalesce("into", s)).drop("into")
        now = now.where("a <> b").groupBy("case", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("rank").alias("rank"))
        done = marks.select("case", "region")
        both = now.join(done.withColumnRenamed("region", "a"), ["case", "a"], "left_semi").join(done.withColumnRenamed("region", "b"), ["case", "b"], "left_semi")
        now = saved(now.join(both.select("case", "a", "b"), ["case", "a", "b"], "left_anti"))
    return _ended(kept.select("case", "node"), rounds).join(marks, ["case", "region"], "left").select("case", "node", "marker")
