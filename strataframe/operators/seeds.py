"""Seeds that cover a set of points: k-centre by core-sets of core-sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.core.storage import saved
from strataframe.operators.sparse_labels import farthest_points

#: Points that one task takes of a group, at least.
BLOCK = 8192


def share_budgets(sizes: DataFrame, total: int, weights: dict[str, float]) -> DataFrame:
    """``sizes(case, bucket, n)`` -> (case, bucket, budget): each case's ``total`` split over its buckets by ``weights``.

    Shares are whole: the floor, and one more for the largest remainders, ties by bucket.  Buckets without a
    weight get none; a bucket never gets more than its points, and what is over stays unused."""
    weight = F.lit(0.0)
    for name, w in sorted(weights.items()):
        weight = F.when(F.col("bucket") == name, float(w)).otherwise(weight)
    weighted = sizes.withColumn("w", weight)
    sums = weighted.groupBy("case").agg(F.sum("w").alias("all"))
    exact = weighted.join(sums, "case").where("`all` > 0").withColumn("exact", F.lit(float(total)) * F.col("w") / F.col("all"))
    floor = exact.withColumn("floor", F.floor("exact").cast("long")).withColumn("rest", F.col("exact") - F.col("floor"))
    # As many buckets as there are names of weights stand in a case's list at most.
    listed = floor.groupBy("case").agg((F.lit(total) - F.sum("floor")).alias("left"), F.array_sort(F.collect_list(F.struct((-F.col("rest")).alias("r"), "bucket", "floor", "n"))).alias("all"))
    placed = listed.select("case", "left", F.posexplode("all").alias("place", "x"))
    given = F.col("x.floor") + F.when(F.col("place") < F.col("left"), 1).otherwise(0)
    return placed.select("case", "x.bucket", F.least(given, F.col("x.n")).alias("budget"))


def cover_points(points: DataFrame, budgets: DataFrame, axes: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``points(case, bucket, point, axes...)``, ``budgets(case, bucket, budget)`` -> (case, bucket, point, place).

    Every group, a case's bucket, gets its budget of points so that the farthest point from all of them is
    near: within four times the least possible radius, and within twice that of a group of one block.  Groups
    are cut into blocks of about ``block`` points by hash (four times the budget at least); each block chooses its
    budget of farthest points, one after another, the points so chosen are cut anew, and so on until a group
    is one block.  The first is the point of least id, equal distances fall to the lesser id.  What a task
    holds is a block.  Null ids and coordinates are left out; of repeated ids in a group one counts."""
    axes = list(axes)
    fine = ["case", "bucket", "point", *axes]
    rows = points.select(*fine[:3], *[F.col(a).cast("double").alias(a) for a in axes]).dropna().dropDuplicates(["case", "bucket", "point"])
    now = saved(rows.join(budgets.where("budget > 0"), ["case", "bucket"]))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in now.schema.fields)}, place long"

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point", ignore_index=True)
        chosen = farthest_points(frame[axes].to_numpy(float), int(frame["budget"].iloc[0]))
        return frame.iloc[chosen].assign(place=np.arange(len(chosen)))

    names = [*now.columns, "place"]
    round_ = 0
    while True:
        wanted = F.greatest(F.lit(block), 4 * F.col("budget"))
        sizes = now.groupBy("case", "bucket", "budget").agg(F.count(F.lit(1)).alias("n")).select("case", "bucket", F.ceil(F.col("n") / wanted).cast("int").alias("blocks"))
        sizes = saved(sizes)
        one = sizes.where("blocks > 1").isEmpty()
        cut = now.join(sizes, ["case", "bucket"]).withColumn("block", F.pmod(F.xxhash64("point", F.lit(round_)), F.col("blocks")).cast("int"))
        made = saved(cut.groupBy("case", "bucket", "block").applyInPandas(lambda frame: choose(frame)[names], schema))
        if one:
            return made.select("case", "bucket", "point", "place")
        now, round_ = made.drop("place"), round_ + 1


def farthest_cover(points: DataFrame, budgets: DataFrame, axes: Sequence[str]) -> DataFrame:
    """As ``cover_points``, but each group's seeds are those of one sequence of farthest points over the whole group.

    A round for each seed: points keep their squared distance to the seeds so far, a grouped minimum names the
    farthest, and it's joined back by group.  So the budget, not the size of a group, decides the number of
    rounds, and no group is gathered."""
    axes = list(axes)
    rows = points.select("case", "bucket", "point", *[F.col(a).cast("double").alias(a) for a in axes]).dropna().dropDuplicates(["case", "bucket", "point"])
    now = saved(rows.join(budgets.where("budget > 0"), ["case", "bucket"]).withColumn("d2", F.lit(float("inf"))))
    chosen, place = [], 0
    while True:
        open_rows = now.where((F.col("budget") > place) & (F.col("d2") >= 0))
        first = F.min(F.struct((-F.col("d2")).alias("d"), "point", *axes)).alias("s")
        seeds = saved(open_rows.groupBy("case", "bucket").agg(first).select("case", "bucket", "s.point", *[F.col(f"s.{a}").alias(f"{a}_s") for a in axes]))
        if seeds.isEmpty():
            break
        chosen.append(seeds.select("case", "bucket", "point", F.lit(place).cast("long").alias("place")))
        gap = F.lit(0.0)
        for a in axes:
            gap = gap + (F.col(a) - F.col(f"{a}_s")) * (F.col(a) - F.col(f"{a}_s"))
        met = open_rows.join(seeds.withColumnRenamed("point", "seed"), ["case", "bucket"])
        # A chosen point isn't chosen again.
        far = F.when(F.col("point") == F.col("seed"), -1.0).otherwise(F.least("d2", gap))
        now, place = saved(met.select(*rows.columns, "budget", far.alias("d2"))), place + 1
    out = now.select("case", "bucket", "point", F.lit(0).cast("long").alias("place")).limit(0)
    for part in chosen:
        out = out.unionByName(part)
    return out


def cover_radius(points: DataFrame, seeds: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(case, bucket, radius): the greatest distance of a point to the nearest seed of its group.

    Seeds meet points by group, as many pairs as points times budget; minima are taken where they arise."""
    axes = list(axes)
    where = seeds.join(points.select("case", "bucket", "point", *[F.col(a).alias(f"{a}_s") for a in axes]), ["case", "bucket", "point"]).drop("point", "place")
    d2 = F.lit(0.0)
    for a in axes:
        d2 = d2 + (F.col(a) - F.col(f"{a}_s")) * (F.col(a) - F.col(f"{a}_s"))
    near = points.join(where, ["case", "bucket"]).groupBy("case", "bucket", "point").agg(F.min(d2).alias("d2"))
    return near.groupBy("case", "bucket").agg(F.sqrt(F.max("d2")).alias("radius"))
