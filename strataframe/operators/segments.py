"""Votes, robust statistics and renumbering of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, segment: list[str], label: str) -> DataFrame:
    """Most frequent label of each segment; the least of equally frequent ones.

    Counts come before the choice, so a hot segment is a few rows."""
    counts = df.groupBy(*segment, label).agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy(*segment).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(label).alias("l"))).alias("x"), F.sum("votes").alias("n"))
    return best.select(*segment, F.col("x.l").alias("label"), (-F.col("x.v")).alias("votes"), "n")


def majority_without_ties(df: DataFrame, segment: list[str], label: str, fallback) -> DataFrame:
    """As ``majority``, but ``fallback`` where several labels are equally frequent."""
    counts = df.groupBy(*segment, label).agg(F.count(F.lit(1)).alias("votes"))
    most = F.max("votes").over(Window.partitionBy(*segment))
    top = counts.withColumn("most", most).where("votes = most").groupBy(*segment).agg(F.count(F.lit(1)).alias("ties"), F.min(label).alias("first"), F.max("votes").alias("votes"))
    return top.select(*segment, F.when(F.col("ties") > 1, F.lit(fallback)).otherwise(F.col("first")).alias("label"), "votes", "ties")


def mean_ensemble(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("mean"))


def robust_moments(df: DataFrame, segment: list[str], value: str, trim: float = 0.1) -> DataFrame:
    """Mean, deviation, median, median absolute deviation, and the mean without both tails."""
    base = df.groupBy(*segment).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.median(value).alias("median"), F.count(value).alias("n"))
    near = df.join(base.select(*segment, "median"), segment)
    mad = near.groupBy(*segment).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    place = F.row_number().over(Window.partitionBy(*segment).orderBy(value))
    ranked = df.withColumn("place__", place).join(base.select(*segment, "n"), segment)
    cut = F.floor(F.col("n") * trim)
    inner = ranked.where((F.col("place__") > cut) & (F.col("place__") <= F.col("n") - cut)).groupBy(*segment).agg(F.avg(value).alias("trimmed_mean"))
    return base.join(mad, segment).join(inner, segment)


def quantiles(df: DataFrame, segment: list[str], value: str, at: list[float]) -> DataFrame:
    found = df.groupBy(*segment).agg(F.percentile(value, F.array(*[F.lit(float(q)) for q in at])).alias("q__"))
    return found.select(*segment, *[F.get("q__", F.lit(i)).alias(f"q{int(q * 100):02d}") for i, q in enumerate(at)])


def dense_labels(df: DataFrame, label: str, name: str = "dense") -> DataFrame:
    """Labels renumbered from 1 in order.  The distinct labels are numbered, then joined back."""
    from strataframe.core.storage import with_row_index

    numbered = with_row_index(df.select(F.col(label).alias("old__")).distinct(), "old__")
    both = df.join(numbered, F.col(label).eqNullSafe(F.col("old__")))
    return both.withColumn(name, F.col("row_index") + 1).drop("old__", "row_index")


def running_correlation(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted correlation from mergeable sums; null where a variance is 0."""
    sums = df.groupBy(*keys).agg(
        F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * y * y).alias("wyy"), F.sum(w * x * y).alias("wxy")
    )
    c = F.col
    cov = c("wxy") / c("w") - c("wx") / c("w") * (c("wy") / c("w"))
    var = lambda a, b: c(a) / c("w") - c(b) / c("w") * (c(b) / c("w"))
    both = F.greatest(var("wxx", "wx"), F.lit(0.0)) * F.greatest(var("wyy", "wy"), F.lit(0.0))
    return sums.select(*keys, F.try_divide(cov, F.nullif(F.sqrt(both), F.lit(0.0))).alias("corr"))
