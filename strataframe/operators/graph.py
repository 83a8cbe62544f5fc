"""Nearest-neighbour graphs, affinities, label propagation and kernel distances over vectors."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strataframe.core.storage import saved


#: Pairs whose exact distances are taken at once.
FAR = 1 << 14
#: Partitions that pairs of blocks are dealt to at most; beyond, a partition holds several pairs.
PAIRS = 1 << 12


def _nearest(here: pd.DataFrame, there: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of ``there`` to each of ``here``, itself left out, by exact distances.

    A matrix product finds who may be among the k, its rounding allowed for."""
    x, y = (np.stack(f["v__"].to_numpy()).astype(float) for f in (here, there))
    own, other, xx, yy = here["src"].to_numpy(), there["src"].to_numpy(), (x * x).sum(1), (y * y).sum(1)
    slack, parts = 1e-9 * (1.0 + xx.max(initial=0.0) + yy.max(initial=0.0)), []
    for a in range(0, len(x), 256):
        about = xx[a : a + 256, None] + yy - 2 * (x[a : a + 256] @ y.T)
        about[own[a : a + 256, None] == other] = np.inf
        last = np.partition(about, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
        i, j = np.nonzero((about <= last[:, None] + slack) & (about < np.inf))
        far = np.concatenate([np.zeros(0), *[np.sqrt(((y[j[b : b + FAR]] - x[a + i[b : b + FAR]]) ** 2).sum(1)) for b in range(0, len(i), FAR)]])
        order = np.lexsort((other[j], far, i))
        i, j, far = i[order], j[order], far[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        parts.append(pd.DataFrame({"src": own[a + i[best]], "dst": other[j[best]], "distance": far[best]}))
    return pd.concat(parts)


def knn(df: DataFrame, node: str, vector: str, group: str, k: int, block: int = 2048) -> DataFrame:
    """``(group, src, dst, distance, place)``: the k nearest other nodes within each group, ties to the lesser node.

    Groups (images, cells, labels) are cut into blocks of about ``block`` nodes by hash; a task compares
    two blocks by matrix products and keeps k rows a node, so no pair leaves it that can't count, and
    a group of any size takes no more memory in a task.  The work stays quadratic in a group.  Null
    groups and nodes, and vectors that are null or hold a null, are left out; only vectors of one length
    are compared; repeated nodes aren't their own neighbours."""
    rows = df.select(F.col(group).alias("group"), F.col(node).alias("src"), F.col(vector).cast("array<double>").alias("v__"))
    rows = rows.where("group is not null and src is not null and size(v__) > 0 and forall(v__, x -> x is not null)").withColumn("dim__", F.size("v__"))
    sizes = rows.groupBy("group", "dim__").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks__"))
    cut = rows.join(sizes, ["group", "dim__"]).withColumn("own__", F.pmod(F.xxhash64("src"), F.col("blocks__")).cast("int"))
    every = cut.withColumn("other__", F.explode(F.sequence(F.lit(0), F.col("blocks__") - 1)))
    every = every.select("group", "dim__", "src", "v__", "own__", F.least("own__", "other__").alias("i__"), F.greatest("own__", "other__").alias("j__"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField("group", kinds["group"]), StructField("src", kinds["src"]), StructField("dst", kinds["src"]), StructField("distance", DoubleType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [frame[frame["own__"] == n] for n in sorted({frame["i__"].iloc[0], frame["j__"].iloc[0]})]
        if not all(len(side) for side in sides):
            return pd.DataFrame({"group": frame["group"][:0], "src": frame["src"][:0], "dst": frame["src"][:0], "distance": np.zeros(0)})
        found = pd.concat([_nearest(sides[0], sides[-1], k), *([_nearest(sides[1], sides[0], k)] if len(sides) > 1 else [])])
        return found.assign(group=frame["group"].iloc[0])[["group", "src", "dst", "distance"]]

    # Work goes with pairs of blocks, not with bytes, so partitions aren't left to be merged by their bytes.
    pairs = sizes.agg(F.sum(F.col("blocks__") * (F.col("blocks__") + 1) / 2)).first()[0] or 1
    dealt = every.repartition(int(min(max(pairs, 1), PAIRS)), "group", "dim__", "i__", "j__")
    near = dealt.groupBy("group", "dim__", "i__", "j__").applyInPandas(run, schema)
    place = F.row_number().over(Window.partitionBy("group", "src").orderBy("distance", "dst"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def median_sigma(edges: DataFrame) -> float:
    """Median of the finite positive distances; 1 without any."""
    ok = edges.where((F.col("distance") > 0) & (F.col("distance") < float("inf")))
    return ok.agg(F.median("distance")).first()[0] or 1.0


def affinity(edges: DataFrame, sigma: float | None = None) -> DataFrame:
    """Symmetric edges weighted by exp(-d^2 / (2 sigma^2)), normalised by the roots of both degrees."""
    edges = saved(edges.select("src", "dst", "distance"))  # read several times, and dear to make
    sigma = sigma or median_sigma(edges)
    one_way = edges.select("src", "dst", F.exp(-F.col("distance") * F.col("distance") / (2 * sigma * sigma)).alias("w"))
    both = saved(one_way.union(one_way.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w")))
    degree = both.groupBy("src").agg(F.sum("w").alias("d"))
    left = both.join(degree, "src")
    right = degree.select(F.col("src").alias("dst"), F.col("d").alias("d2"))
    return left.join(right, "dst").select("src", "dst", "w", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("norm"))


def propagate(nodes: DataFrame, edges: DataFrame, alpha: float, rounds: int, clamp: bool = True) -> DataFrame:
    """Label scores spread along normalised edges: F <- alpha S F + (1 - alpha) Y, seeds held if ``clamp``.

    ``nodes(node, label)`` with -1 for unlabelled.  Each round is written to the shared folder, so the
    plan doesn't grow with the rounds.  Returns the best label of each node that any label reached."""
    seeds = saved(nodes.where("label >= 0").select("node", "label", F.lit(1.0).alias("score")))
    edges = saved(edges.select("src", "dst", "norm"))
    now = seeds
    for _ in range(rounds):
        spread = edges.join(now, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node"), "label").agg((alpha * F.sum(F.col("norm") * F.col("score"))).alias("score"))
        mixed = spread.union(seeds.withColumn("score", F.lit(1.0 - alpha))).groupBy("node", "label").agg(F.sum("score").alias("score"))
        if clamp:
            mixed = mixed.join(seeds.select("node"), "node", "left_anti").union(seeds)
        now = saved(mixed)
    best = now.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("label").alias("l"))).alias("x"))
    return best.select("node", F.col("x.l").alias("label"), (-F.col("x.s")).alias("score"))


class Propagated(NamedTuple):
    """Scores (node, label, score) of the solution, the greatest relative residual of a label, and the rounds taken."""

    scores: DataFrame
    residual: float
    rounds: int


def propagate_fully(nodes: DataFrame, edges: DataFrame, alpha: float, tolerance: float = 1e-8, most_rounds: int = 1000) -> Propagated:
    """The limit of F <- alpha S F + (1 - alpha) Y, by conjugate gradients on (I - alpha S) F = (1 - alpha) Y.

    ``nodes(node, label)`` with -1 or null for unlabelled; ``edges(src, dst, norm)`` hold S, symmetric, as ``affinity``
    gives it.  All labels are solved at once: a round is one join of edges with the directions, one sum by node
    and label, and four sums by label, from which both step lengths follow; its state is written to the shared
    folder.  Only nodes that a label has reached have rows.  It ends once every label's residual is at most
    ``tolerance`` times the length of its right side."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    edges = saved(edges.select("src", "dst", (F.col("norm") * alpha).alias("w")))
    right = nodes.where("label >= 0").select("node", "label", F.lit(1.0 - alpha).alias("r")).distinct()
    zero = F.lit(0.0)
    now = saved(right.select("node", "label", zero.alias("x"), "r", F.col("r").alias("p")))
    bars = saved(right.groupBy("label").agg(F.sum(F.col("r") * F.col("r")).alias("bb")))
    rounds, residual = 0, 0.0 if now.isEmpty() else 1.0
    while residual > tolerance and rounds < most_rounds:
        spread = edges.join(now.select(F.col("node").alias("dst"), "label", "p"), "dst").groupBy("src", "label").agg((-F.sum(F.col("w") * F.col("p"))).alias("q"))
        given = now.select("node", "label", "x", "r", "p", F.col("p").alias("q")).unionByName(spread.select(F.col("src").alias("node"), "label", zero.alias("x"), zero.alias("r"), zero.alias("p"), "q"))
        full = saved(given.groupBy("node", "label").agg(*[F.sum(c).alias(c) for c in "xrpq"]))
        c = {n: F.sum(F.col(n[0]) * F.col(n[1])).alias(n) for n in ("rr", "pq", "rq", "qq")}
        step = F.when(F.col("pq") > 0, F.col("rr") / F.col("pq")).otherwise(0.0)
        sums = full.groupBy("label").agg(*c.values()).withColumn("a", step)
        left = F.greatest(F.col("rr") - 2 * F.col("a") * F.col("rq") + F.col("a") * F.col("a") * F.col("qq"), zero)
        sums = saved(sums.select("label", "a", left.alias("rest"), F.when(F.col("rr") > 0, left / F.col("rr")).otherwise(0.0).alias("b")))
        r = F.col("r") - F.col("a") * F.col("q")
        now = saved(full.join(sums, "label").select("node", "label", (F.col("x") + F.col("a") * F.col("p")).alias("x"), r.alias("r"), (r + F.col("b") * F.col("p")).alias("p")))
        residual, rounds = float(sums.join(bars, "label").agg(F.max(F.sqrt(F.col("rest") / F.col("bb")))).first()[0]), rounds + 1
    return Propagated(now.select("node", "label", F.col("x").alias("score")), residual, rounds)


def best_labels(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(node, label, score) of every node: its label of greatest score, the lesser of equal ones; null where none came."""
    best = scores.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("best"))
    return nodes.select("node").distinct().join(best, "node", "left").select("node", "best.label", (-F.col("best.s")).alias("score"))


def mmd_linear(df: DataFrame, vector: str, group: Column) -> DataFrame:
    """Squared distance of the mean vectors of two groups (true and false of ``group``)."""
    cells = df.select(group.alias("g"), F.posexplode(vector).alias("i", "v"))
    means = cells.groupBy("i").agg(F.avg(F.when(F.col("g"), F.col("v").cast("double"))).alias("a"), F.avg(F.when(~F.col("g"), F.col("v").cast("double"))).alias("b"))
    return means.agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mmd"))
