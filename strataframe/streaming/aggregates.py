"""Streaming averages, time windows with late data, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_average(stream: DataFrame, keys: list[str], value: str, count: str | None = None) -> DataFrame:
    """Weighted mean of all finite values so far; write it in update or complete mode."""
    v, n = F.col(value), F.col(count) if count else F.lit(1.0)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return stream.where(finite).groupBy(*keys).agg((F.sum(v * n) / F.sum(n)).alias("average"), F.sum(n).alias("weight"))


def tumbling(stream: DataFrame, time: str, keys: list[str], value: str, length: str, late: str) -> DataFrame:
    """Counts and sums by time window; rows later than ``late`` are dropped by the watermark."""
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *keys)
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sessions(stream: DataFrame, time: str, keys: list[str], value: str, gap: str, late: str) -> DataFrame:
    """Counts and sums by session, which ends when nothing comes for ``gap``."""
    windowed = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def confusion_counts(stream: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """Cumulative tp, fp, tn and fn, from which every confusion metric follows."""
    p, t = F.col(pred), F.col(truth)
    return stream.groupBy(*keys).agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("tp", p & t), ("fp", p & ~t), ("tn", ~p & ~t), ("fn", ~p & t))])
