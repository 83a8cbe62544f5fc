"""Sparse-label analytics on volumes: masks and bands, budgets, seeds, and diffusion to neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.core.storage import saved
from strataframe.operators import volumes as V
from strataframe.operators.partition import hash_order


def boundary(mask: np.ndarray) -> np.ndarray:
    """Mask less its erosion."""
    return mask & ~(V.erode(3)(np.where(mask, 1.0, 0.0)) > 0)


def interior(mask: np.ndarray, depth: int = 1) -> np.ndarray:
    for _ in range(depth):
        mask = mask & ~boundary(mask)
    return mask


def shell(mask: np.ndarray, width: float, outside: bool) -> np.ndarray:
    """Places within ``width`` of the border, on one side of it."""
    side = ~mask if outside else mask
    d = V.distance_transform()(side.astype(float))
    return side & (d <= width)


def surface_weight(mask: np.ndarray) -> int:
    return int(boundary(mask).sum())


def bounding_box(mask: np.ndarray, margin: int = 0) -> list[tuple[int, int]]:
    at = np.argwhere(mask)
    return [(max(int(a) - margin, 0), min(int(b) + 1 + margin, n)) for a, b, n in zip(at.min(0), at.max(0), mask.shape, strict=True)] if len(at) else [(0, 0)] * mask.ndim


def farthest_points(points: np.ndarray, count: int, first: int = 0) -> list[int]:
    """Greedy choice: each next point is the farthest from those chosen; the first of equal ones."""
    if not len(points):
        return []
    chosen, d = [first], ((points - points[first]) ** 2).sum(1)
    while len(chosen) < min(count, len(points)):
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((points - points[chosen[-1]]) ** 2).sum(1))
    return chosen


def budget_split(total: int, weights: Sequence[float]) -> list[int]:
    """Whole shares of a budget by weight; what is left goes to the largest remainders, earlier first."""
    exact = [total * w / sum(weights) for w in weights] if sum(weights) else [0.0] * len(weights)
    out = [int(e) for e in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: (total - sum(out)) if sum(weights) else 0]:
        out[i] += 1
    return out


def stratified_seeds(df: DataFrame, case: str, label: str, place: str, count: int, seed: int) -> DataFrame:
    """``count`` places of each label of each case, by hash order."""
    order = Window.partitionBy(case, label).orderBy(hash_order(seed, case, place), place)
    return df.withColumn("pick__", F.row_number().over(order)).where(F.col("pick__") <= count).drop("pick__")


def supervised_slices(df: DataFrame, case: str, axis: str, label: str, count: int) -> DataFrame:
    """The slices of each case with most foreground; ties go to the lower slice."""
    sums = df.where(F.col(label) > 0).groupBy(case, axis).agg(F.count(F.lit(1)).alias("foreground"))
    place = F.row_number().over(Window.partitionBy(case).orderBy(F.desc("foreground"), axis))
    return sums.withColumn("place", place).where(F.col("place") <= count)


def distance_bucket(label: Column, distance: Column, near: float) -> Column:
    """Foreground, background near the border, or outer background."""
    return F.when(label > 0, "foreground").when(distance <= near, "boundary").otherwise("outer")


def chi2_distance(a: Column, b: Column) -> Column:
    part = F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + 1e-12))
    return F.sqrt(F.greatest(0.5 * F.aggregate(part, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    sizes = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return 1.0 - dot / (sizes + 1e-12)


def grid_neighbours(cells: DataFrame, case: str, axes: Sequence[str], full: bool = False) -> DataFrame:
    """Pairs of neighbouring cells of a grid that both exist: an equality join on shifted places."""
    steps = F.array(*[F.array(*map(F.lit, o)) for o in V._offsets(len(axes), full)])
    moved = cells.withColumn("step__", F.explode(steps))
    moved = moved.select(F.col(case).alias("case"), *[F.col(a).alias(f"{a}_a") for a in axes], *[(F.col(a) + F.get("step__", F.lit(i))).alias(f"{a}_b") for i, a in enumerate(axes)])
    there = cells.select(F.col(case).alias("case"), *[F.col(a).alias(f"{a}_b") for a in axes])
    return moved.join(there, ["case", *[f"{a}_b" for a in axes]])


def diffuse(cells: DataFrame, case: str, axes: Sequence[str], label: str, alpha: float, rounds: int, full: bool = False) -> DataFrame:
    """Label scores averaged over grid neighbours (rows normalised), seeds held; -1 is unlabelled.

    Returns each reached cell's best label and score.  Each round is written to the shared folder."""
    pairs = grid_neighbours(cells, case, axes, full)
    degree = pairs.groupBy("case", *[f"{a}_a" for a in axes]).agg(F.count(F.lit(1)).alias("degree"))
    pairs = saved(pairs.join(degree, ["case", *[f"{a}_a" for a in axes]]))
    key = ["case", *axes]
    seeds = saved(cells.where(F.col(label) >= 0).select(F.col(case).alias("case"), *axes, F.col(label).alias("label"), F.lit(1.0).alias("score")))
    now = seeds
    for _ in range(rounds):
        there = now.select("case", *[F.col(a).alias(f"{a}_b") for a in axes], "label", "score")
        spread = pairs.join(there, ["case", *[f"{a}_b" for a in axes]])
        new = spread.groupBy("case", *[F.col(f"{a}_a").alias(a) for a in axes], "label").agg((alpha * F.sum(F.col("score") / F.col("degree"))).alias("score"))
        now = saved(new.join(seeds.select(*key), key, "left_anti").union(seeds.select(*key, "label", "score")))
    best = now.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("label").alias("l"))).alias("best__"))
    return best.select(*key, F.col("best__.l").alias("label"), (-F.col("best__.s")).alias("score"))


def frechet_distance(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> float:
    """Distance of two Gaussians; the root of the product comes from symmetric eigenvalues."""
    w, u = np.linalg.eigh(cov_a)
    root = u @ np.diag(np.sqrt(np.maximum(w, 0))) @ u.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ cov_b @ root), 0)).sum()
    return float(((mean_a - mean_b) ** 2).sum() + np.trace(cov_a) + np.trace(cov_b) - 2 * cross)


def gaussian_fit(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of vectors from mergeable sums: one row per task and pair of places."""
    rows = df.select(F.col(vector).alias("v"))
    n = rows.count()
    places = F.posexplode("v")
    first = rows.select("v", places.alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("s")).orderBy("i").collect()
    second = rows.select("v", places.alias("i", "x")).select("i", "x", F.posexplode("v").alias("j", "y")).where("i <= j")
    sums = second.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("s")).collect()
    mean = np.array([r.s for r in first]) / n
    cov = np.zeros((len(first), len(first)))
    for r in sums:
        cov[r.i, r.j] = cov[r.j, r.i] = (r.s - n * mean[r.i] * mean[r.j]) / (n - 1)
    return mean, cov


def fid(a: DataFrame, b: DataFrame, vector: str) -> float:
    return frechet_distance(*gaussian_fit(a, vector), *gaussian_fit(b, vector))
