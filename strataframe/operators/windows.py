"""Sliding windows over positions, smoothing, cumulative values and best-of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_starts(n: Column, size: int, overlap: float) -> Column:
    """Starts of inference windows: fixed steps, the last window shifted back inside."""
    step = max(int(size * (1 - overlap)), 1)
    last = F.greatest(n - size, F.lit(0))
    count = F.ceil(last / F.lit(float(step))).cast("long") + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.least(i * step, last)))


def sliding_merge(df: DataFrame, keys: list[str], position: str, value: str, size: int, overlap: float, score: Column, center_weight: bool = True) -> DataFrame:
    """Splits each series into windows, scores each window by an aggregate, and averages the scores of
    the windows over each position, weighted by nearness to the window's centre."""
    ends = df.groupBy(*keys).agg((F.max(position) + 1).alias("n__"))
    windows = ends.withColumn("start", F.explode(window_starts(F.col("n__"), size, overlap))).drop("n__")
    # A position meets windows whose start lies within one window before it: both are dealt into
    # blocks of the window's length, so the join is an equality on series and block.
    blocks = windows.withColumn("b__", F.explode(F.array((F.col("start") / size).cast("long"), ((F.col("start") + size - 1) / size).cast("long")))).distinct()
    rows = df.withColumn("b__", (F.col(position) / size).cast("long"))
    inside = rows.join(blocks, [*keys, "b__"]).where((F.col(position) >= F.col("start")) & (F.col(position) < F.col("start") + size))
    scored = inside.groupBy(*keys, "start").agg(score.alias("score"))
    middle = (size - 1) / 2.0
    weight = 1.0 / (1.0 + F.abs(F.col(position) - F.col("start") - middle)) if center_weight else F.lit(1.0)
    merged = inside.join(scored, [*keys, "start"]).withColumn("w__", weight)
    return merged.groupBy(*keys, position).agg((F.sum(F.col("w__") * F.col("score")) / F.sum("w__")).alias("merged"), F.count(F.lit(1)).alias("n_windows"))


def patches(df: DataFrame, keys: list[str], position: str, value: str, size: int) -> DataFrame:
    """Sums of adjoining patches of each series; a patch that is cut off at the end is kept."""
    return df.groupBy(*keys, (F.floor(F.col(position) / size)).cast("long").alias("patch")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def top_patches(patched: DataFrame, keys: list[str], k: int, largest: bool = True) -> DataFrame:
    """The k patches of greatest (or least) sum of each series; ties go to the earlier patch."""
    by = F.desc("total") if largest else F.asc("total")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(by, "patch"))
    return patched.withColumn("place", place).where(F.col("place") <= k)


def filter_patches(patched: DataFrame, limit: float) -> DataFrame:
    """Patches whose sum is below the limit."""
    return patched.where(F.col("total") < limit)


def _around(keys: list[str], order: list[str], radius: int):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)


def median_smooth(df: DataFrame, keys: list[str], order: list[str], value: str, radius: int) -> DataFrame:
    """Median of the neighbours within ``radius`` places."""
    near = F.sort_array(F.collect_list(value).over(_around(keys, order, radius)))
    n = F.size("near__")
    low, high = F.get("near__", F.floor((n - 1) / 2).cast("int")), F.get("near__", F.floor(n / 2).cast("int"))
    return df.withColumn("near__", near).withColumn("smoothed", (low + high) / 2).drop("near__")


def mean_smooth(df: DataFrame, keys: list[str], order: list[str], value: str, radius: int) -> DataFrame:
    return df.withColumn("smoothed", F.avg(value).over(_around(keys, order, radius)))


def cumulative(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Running sum and running maximum."""
    up_to = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"running_sum": F.sum(value).over(up_to), "running_max": F.max(value).over(up_to)})


def shift(df: DataFrame, keys: list[str], order: list[str], value: str, places: int, fill: float = 0.0) -> DataFrame:
    moved = F.lag(value, places).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("shifted", F.coalesce(moved, F.lit(fill)))


def early_stop(df: DataFrame, keys: list[str], order: list[str], value: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """First place of each series at which ``patience`` places have passed since the best value so far."""
    sort = Window.partitionBy(*keys).orderBy(*order)
    before = sort.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(sort)
    best = F.max(value).over(before)
    gain = best.isNull() | (F.col(value) > best + min_delta)
    marked = df.withColumns({"place": place, "gain__": gain})
    since = F.max(F.when(F.col("gain__"), F.col("place"))).over(sort.rowsBetween(Window.unboundedPreceding, 0))
    late = marked.withColumn("since__", since).where(F.col("place") - F.col("since__") >= patience)
    return late.groupBy(*keys).agg(F.min("place").alias("stop_place"))


def best_place(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Place and value of the best row of each series; the earliest of equal ones."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = df.withColumn("place", place).groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("place")).alias("p"))).alias("x"))
    return top.select(*keys, F.col("x.v").alias("best_value"), (-F.col("x.p")).alias("best_place"))


def best_n(df: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    """The n rows of greatest score of each group, ties by a second column."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return df.withColumn("place", place).where(F.col("place") <= n)
