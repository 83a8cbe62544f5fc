"""Scaling, clipping, normalising, thresholding and relabelling of values within groups.

Group statistics are aggregated and joined back, so a hot group is summed in parts and never one
window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """``df`` with aggregates of its groups as columns."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in stats.items()])))
    found = df.groupBy(*[F.col(k).alias(f"{k}__k") for k in keys]).agg(*[c.alias(n) for n, c in stats.items()])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"{k}__k"))
        on = same if on is None else on & same
    return df.join(found, on).drop(*[f"{k}__k" for k in keys])


def scale_min_max(df: DataFrame, keys: list[str], value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rescales each group to [low, high]; a constant group is multiplied by ``low``."""
    both = _with_stats(df, keys, lo__=F.min(value), hi__=F.max(value))
    v, span = F.col(value), F.col("hi__") - F.col("lo__")
    out = F.when(span == 0, v * low).otherwise((v - F.col("lo__")) / F.nullif(span, F.lit(0.0)) * (high - low) + low)
    return both.withColumn("scaled", out).drop("lo__", "hi__")


def scale_range(value: Column, a_min: float, a_max: float, b_min: float | None, b_max: float | None, clip: bool = False) -> Column:
    """Maps [a_min, a_max] to [b_min, b_max]; an empty input range only shifts, and does not clip."""
    if a_min == a_max:
        return value - a_min if b_min is None else value - a_min + b_min
    out = (value - a_min) / (a_max - a_min)
    if b_min is not None and b_max is not None:
        out = out * (b_max - b_min) + b_min
    if clip and b_min is not None and b_max is not None:
        out = F.least(F.greatest(out, F.lit(float(b_min))), F.lit(float(b_max)))
    return out


def scale_percentiles(df: DataFrame, keys: list[str], value: str, lower: float, upper: float, b_min: float, b_max: float, clip: bool) -> DataFrame:
    """Maps each group's percentile range to [b_min, b_max]."""
    both = _with_stats(df, keys, lo__=F.percentile(value, lower / 100), hi__=F.percentile(value, upper / 100))
    v, span = F.col(value), F.col("hi__") - F.col("lo__")
    out = F.when(span == 0, v - F.col("lo__") + b_min).otherwise((v - F.col("lo__")) / F.nullif(span, F.lit(0.0)) * (b_max - b_min) + b_min)
    if clip:
        out = F.when(span == 0, out).otherwise(F.least(F.greatest(out, F.lit(b_min)), F.lit(b_max)))
    return both.withColumn("scaled", out).drop("lo__", "hi__")


def clip_percentiles(df: DataFrame, keys: list[str], value: str, lower: float, upper: float) -> DataFrame:
    """Values clipped to their group's percentiles."""
    both = _with_stats(df, keys, lo__=F.percentile(value, lower / 100), hi__=F.percentile(value, upper / 100))
    return both.withColumn("clipped", F.least(F.greatest(F.col(value), F.col("lo__")), F.col("hi__"))).drop("lo__", "hi__")


def normalize(df: DataFrame, keys: list[str], value: str, nonzero: bool = False) -> DataFrame:
    """Subtracts the mean and divides by the population deviation, 0 standing for 1.

    ``nonzero``: zeros are left out of both and stay as they are."""
    v = F.col(value)
    used = F.when(v != 0, v) if nonzero else v
    both = _with_stats(df, keys, mu__=F.avg(used), sd__=F.stddev_pop(used))
    out = (v - F.col("mu__")) / F.when(F.col("sd__") == 0, F.lit(1.0)).otherwise(F.col("sd__"))
    return both.withColumn("normalized", F.when(v == 0, v).otherwise(out) if nonzero else out).drop("mu__", "sd__")


def threshold(value: Column, limit: float, above: bool = True, fill: float = 0.0) -> Column:
    """Keeps values above (or below) the limit; all others become ``fill``."""
    return F.when(value > limit if above else value < limit, value).otherwise(F.lit(fill))


def soft_clip(value: Column, low: float, high: float, sharpness: float = 1.0) -> Column:
    """Clips with softened corners."""
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return value + (soft(-sharpness * (value - low)) - soft(sharpness * (value - high))) / sharpness


def adjust_contrast(df: DataFrame, keys: list[str], value: str, gamma: float) -> DataFrame:
    """((v - min) / range) ** gamma * range + min within each group."""
    both = _with_stats(df, keys, lo__=F.min(value), hi__=F.max(value))
    span = F.col("hi__") - F.col("lo__")
    out = F.pow((F.col(value) - F.col("lo__")) / (span + 1e-7), F.lit(gamma)) * span + F.col("lo__")
    return both.withColumn("adjusted", out).drop("lo__", "hi__")


def relabel(value: Column, mapping: dict) -> Column:
    """Each original value by the mapping; values without an entry stay."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(pairs, value), value)


def equalize_histogram(df: DataFrame, value: str, bins: int, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Maps values through the cumulative histogram, linearly between bin edges."""
    from pyspark.sql import Window

    ends = df.agg(F.min(value).alias("lo__"), F.max(value).alias("hi__"))
    both = df.crossJoin(F.broadcast(ends))
    width = (F.col("hi__") - F.col("lo__")) / bins
    cell = F.least(F.floor((F.col(value) - F.col("lo__")) / width), F.lit(bins - 1)).cast("int")
    counts = both.groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dense = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0, ["n"])
    up_to = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as bins
    summed = dense.withColumn("c", F.sum("n").over(up_to))
    lo, hi = F.min("c").over(Window.partitionBy()), F.max("c").over(Window.partitionBy())
    scaled = summed.select("bin", (F.when(hi == lo, F.lit(low)).otherwise((F.col("c") - lo) / F.nullif(hi - lo, F.lit(0))) * (high - low) + low).alias("y"))
    pair = scaled.select("bin", "y", F.coalesce(F.lead("y").over(Window.orderBy("bin")), F.col("y")).alias("y2"))
    at = both.withColumn("bin", cell).join(F.broadcast(pair), "bin")
    part = (F.col(value) - F.col("lo__") - F.col("bin") * width) / width
    return at.withColumn("equalized", F.col("y") + F.least(part, F.lit(1.0)) * (F.col("y2") - F.col("y"))).drop("lo__", "hi__", "bin", "y", "y2")
