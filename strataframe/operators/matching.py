"""Matching: anchors with true boxes by the statistics of their nearest anchors, and one-to-one by greatest total."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.core.components import components
from strataframe.core.storage import saved, whole_groups
from strataframe.operators.boxes import CORNERS


def _centres(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2})


def nearest_anchors(truths: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(image, truth, level, anchor, d2): for each truth and level the k anchors of least squared centre distance.

    Anchors of an image and level are dealt to cells that hold about k of them on average.  A truth asks the
    cells around its own, one ring at first and twice as many in each round, until its k-th anchor is no
    farther than the rings reach, so the answer is exact; only truths that are still open ask again.  Equal
    distances fall to the lesser anchor.  Fewer than k anchors are all taken."""
    places = saved(_centres(anchors).select("image", "level", "anchor", F.col("cx").alias("ax"), F.col("cy").alias("ay")))
    grouped = places.groupBy("image", "level").agg(F.count(F.lit(1)).alias("n"), F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    side = F.sqrt(F.greatest(wide, F.lit(1e-9)) * F.greatest(high, F.lit(1e-9)) * k / F.col("n"))
    # Anchors in one line have no area: their length decides then, and one spot is one cell.
    cell = F.greatest(side, F.greatest(wide, high) * k / F.col("n"), F.lit(1e-6))
    extents = saved(grouped.withColumn("cell", cell))
    at = lambda x, low: F.floor((F.col(x) - F.col(low)) / F.col("cell")).cast("long")
    dealt = saved(places.join(extents, ["image", "level"]).select(*places.columns, at("ax", "x0").alias("gx"), at("ay", "y0").alias("gy")))
    asked = _centres(truths).select("image", "truth", F.col("cx").alias("tx"), F.col("cy").alias("ty")).join(extents, "image")
    cells = {"hx": at("tx", "x0"), "hy": at("ty", "y0"), "lastx": at("x1", "x0"), "lasty": at("y1", "y0")}
    still, reach, done = saved(asked.withColumns(cells)), 1, []
    rank = F.row_number().over(Window.partitionBy("image", "truth", "level").orderBy("d2", "anchor"))
    while not still.isEmpty():
        ring = lambda h, last: F.sequence(F.least(F.greatest(F.col(h) - reach, F.lit(0)), F.col(last)), F.greatest(F.least(F.col(h) + reach, F.col(last)), F.lit(0)))  # noqa: E731, B023
        asks = still.withColumn("gx", F.explode(ring("hx", "lastx"))).withColumn("gy", F.explode(ring("hy", "lasty")))
        near = asks.join(dealt, ["image", "level", "gx", "gy"])
        d2 = (F.col("ax") - F.col("tx")) * (F.col("ax") - F.col("tx")) + (F.col("ay") - F.col("ty")) * (F.col("ay") - F.col("ty"))
        best = saved(near.select("image", "truth", "level", "anchor", d2.alias("d2"), "n", "cell").withColumn("place", rank).where(F.col("place") <= k))
        seen = best.groupBy("image", "truth", "level").agg(F.count(F.lit(1)).alias("m"), F.max("d2").alias("far"), F.first("n").alias("n"), F.first("cell").alias("cell"))
        sure = seen.where((F.col("m") == F.col("n")) | ((F.col("m") == k) & (F.col("far") <= F.col("cell") * F.col("cell") * (reach * reach)))).select("image", "truth", "level")
        done.append(best.join(sure, ["image", "truth", "level"], "left_semi").select("image", "truth", "level", "anchor", "d2"))
        still, reach = saved(still.join(sure, ["image", "truth", "level"], "left_anti")), reach * 2
    out = done[0] if done else dealt.select("image", F.lit(None).cast(truths.schema["truth"].dataType).alias("truth"), "level", "anchor", F.lit(0.0).alias("d2")).limit(0)
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def atss_match(truths: DataFrame, anchors: DataFrame, candidates: int = 4, per_place: int = 1, center_inside: bool = True, eps: float = 0.01) -> DataFrame:
    """``truths(image, truth, corners)``, ``anchors(image, level, anchor, corners)`` -> (image, anchor, truth, iou), all anchors.

    A truth's candidates are its nearest candidates * per_place anchors of every level.  Those whose overlap (iou)
    reaches the mean plus the sample deviation of all its candidates' overlaps, and whose centre lies within
    it by more than ``eps`` (if asked), match; an anchor takes the matching truth of greatest overlap, the
    lesser of equal ones, or null.  A truth's only candidate matches in any case.  Overlaps within 1e-9 of
    the bar reach it.  Ids must be unique in an image; images without truths keep their anchors."""
    truths, anchors = saved(truths), saved(anchors)
    near = nearest_anchors(truths, anchors, candidates * per_place)
    sided = lambda df, name, side: df.select("image", name, *[F.col(c).cast("double").alias(f"{side}{c}") for c in CORNERS])
    both = near.join(sided(truths, "truth", "t_"), ["image", "truth"]).join(sided(anchors, "anchor", "a_"), ["image", "anchor"])
    w = F.greatest(F.least("a_xmax", "t_xmax") - F.greatest("a_xmin", "t_xmin"), F.lit(0.0))
    h = F.greatest(F.least("a_ymax", "t_ymax") - F.greatest("a_ymin", "t_ymin"), F.lit(0.0))
    size = lambda s: (F.col(f"{s}xmax") - F.col(f"{s}xmin")) * (F.col(f"{s}ymax") - F.col(f"{s}ymin"))
    union = size("a_") + size("t_") - w * h
    x, y = (F.col("a_xmin") + F.col("a_xmax")) / 2, (F.col("a_ymin") + F.col("a_ymax")) / 2
    inside = F.least(x - F.col("t_xmin"), F.col("t_xmax") - x, y - F.col("t_ymin"), F.col("t_ymax") - y) > eps
    scored = both.select("image", "truth", "anchor", F.when(union > 0, w * h / union).otherwise(0.0).alias("iou"), inside.alias("inside"))
    bars = scored.groupBy("image", "truth").agg(F.count(F.lit(1)).alias("m"), (F.avg("iou") + F.coalesce(F.stddev_samp("iou"), F.lit(0.0))).alias("bar"))
    fits = scored.join(bars, ["image", "truth"]).where((F.col("m") == 1) | ((F.col("iou") >= F.col("bar") - 1e-9) & (F.col("inside") | F.lit(not center_inside))))
    best = fits.groupBy("image", "anchor").agg(F.min(F.struct((-F.col("iou")).alias("x"), "truth")).alias("best"))
    matched = best.select("image", "anchor", "best.truth", (-F.col("best.x")).alias("iou"))
    return anchors.select("image", "anchor").join(matched, ["image", "anchor"], "left")


def best_assignment(values: np.ndarray) -> np.ndarray:
    """For each row its column, or -1, so that the sum of the values so chosen is greatest; values aren't negative.

    Rows are added one by one along shortest augmenting paths with potentials; every row also has a column of
    its own worth nothing."""
    n, m = values.shape
    cost = np.hstack([-values, np.zeros((n, n))])
    u, v, owner = np.zeros(n), np.zeros(m + n), np.full(m + n, -1)
    for start in range(n):
        dist, back, seen = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        row, last, so_far = start, -1, 0.0
        while row >= 0:
            step = so_far + cost[row] - u[row] - v
            better = ~seen & (step < dist)
            dist[better], back[better] = step[better], last
            at = int(np.where(seen, np.inf, dist).argmin())
            so_far, seen[at], last, row = dist[at], True, at, int(owner[at])
        closed = seen.copy()
        closed[last] = False
        u[start] += so_far
        u[owner[closed]] += so_far - dist[closed]
        v[closed] -= so_far - dist[closed]
        while last >= 0:
            owner[last] = owner[back[last]] if back[last] >= 0 else start
            last = int(back[last])
    out = np.full(n, -1)
    for column in range(m):
        if owner[column] >= 0 and values[owner[column], column] > 0:
            out[owner[column]] = column
    return out


#: Pairs of an image that one task may hold whole.
SMALL = 512


def optimal_match(pairs: DataFrame, image: str, truth: str, pred: str, value: str, least: float = 0.0) -> DataFrame:
    """The one-to-one matching of greatest total ``value`` in each image, and of it the pairs over ``least``.

    ``pairs(image, truth, pred, value)`` holds overlapping pairs only.  Boxes or segments that aren't linked by
    overlaps, over any number of steps, don't bear on each other: these clusters are solved exactly one by one.
    Images of at most SMALL pairs are taken whole, many in a task, and fall into their clusters there; of others
    the clusters are found first, as components of the pairs.  So a task holds a small image or a cluster of
    overlapping things.  Rows with nulls, and values of zero or less, are left out; of repeated pairs the
    greatest counts; which of several best matchings is given isn't defined."""
    rows = pairs.select(image, truth, pred, F.col(value).cast("double").alias(value)).dropna().where(F.col(value) > 0)
    rows = saved(rows.groupBy(image, truth, pred).agg(F.max(value).alias(value)))
    sizes = saved(rows.groupBy(image).agg(F.count(F.lit(1)).alias("n__")).where(F.col("n__") > SMALL).select(image))
    dealt = rows.join(sizes, image, "left_anti").withColumn("cluster__", F.lit(""))
    if not sizes.isEmpty():
        large = rows.join(sizes, image, "left_semi")
        end = lambda kind, c: F.struct(F.col(image).cast("string").alias("i"), F.lit(kind).alias("k"), F.col(c).cast("string").alias("n"))
        found = components(large.select(end("t", truth).alias("a"), end("p", pred).alias("b")))
        named = large.withColumn("node", end("t", truth)).join(found, "node").select(image, truth, pred, value, F.to_json("component").alias("cluster__"))
        dealt = dealt.unionByName(named)
    schema, key = rows.schema, [image, "cluster__"]

    def solve(frame: pd.DataFrame) -> np.ndarray:
        """Which rows of a cluster match."""
        row, rows_ = pd.factorize(frame[truth], sort=True)
        column, columns = pd.factorize(frame[pred], sort=True)
        table = np.zeros((len(rows_), len(columns)))
        table[row, column] = frame[value]
        return best_assignment(table)[row] == column

    def run(frames):
        for frame in whole_groups(frames, key):
            group = _clusters(frame, key, truth, pred)
            order = np.argsort(group, kind="stable")
            frame, group = frame.iloc[order], group[order]
            ends = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            kept = [solve(frame.iloc[a:b]) if b - a > 1 else np.ones(1, bool) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield frame.loc[np.concatenate(kept), schema.names]

    sorted_ = dealt.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)
    return sorted_.mapInPandas(run, schema).where(F.col(value) > least)


def _clusters(frame: pd.DataFrame, key: list[str], truth: str, pred: str) -> np.ndarray:
    """For each pair its cluster: pairs of equal ``key`` that share an end, over any number of steps."""
    group = frame.groupby(key, sort=False).ngroup().to_numpy()
    a = frame.assign(g__=group).groupby(["g__", truth], sort=False).ngroup().to_numpy()
    b = frame.assign(g__=group).groupby(["g__", pred], sort=False).ngroup().to_numpy()
    least = np.arange(len(frame))
    while True:
        new = least.copy()
        for end in (a, b):
            low = np.full(end.max() + 1, len(frame))
            np.minimum.at(low, end, new)
            new = low[end]
        if (new == least).all():
            return least
        least = new
