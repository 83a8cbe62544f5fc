"""Two-level statistics, histograms, label shares and bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.core.storage import saved, with_running_sums

PERCENTILES = {"percentile_00_5": 0.005, "percentile_10_0": 0.1, "percentile_90_0": 0.9, "percentile_99_5": 0.995}
STATS = ("max", "mean", "median", "min", "stdev", *PERCENTILES)


def nan_to_null(column: Column) -> Column:
    return F.when(F.isnan(column), None).otherwise(column)


def sample_stats(df: DataFrame, keys: list[str], value: str, accuracy: int | None = None) -> DataFrame:
    """max, mean, median, min, population stdev and percentiles of each group, NaN left out.

    Percentiles interpolate; with ``accuracy`` they are approximate and take bounded memory."""
    v = nan_to_null(F.col(value).cast("double"))
    names = ("median", *PERCENTILES)
    fractions = F.array(*[F.lit(q) for q in (0.5, *PERCENTILES.values())])
    every = F.percentile_approx(v, fractions, accuracy) if accuracy else F.percentile(v, fractions)  # one buffer for all
    found = df.groupBy(*keys).agg(F.max(v).alias("max"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.stddev_pop(v).alias("stdev"), every.alias("q__"))
    at = {name: F.get("q__", F.lit(i)) for i, name in enumerate(names)}
    return found.select(*keys, *[(at[c] if c in at else F.col(c)).alias(c) for c in STATS])


def summarise(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of statistics: extremes exactly, the mean of all others."""
    return stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cases"),
        *[(F.max(s) if s == "max" else F.min(s) if s == "min" else F.avg(s)).alias(s) for s in STATS],
    )


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts per bin, empty bins too; the last bin includes ``high``, values outside are left out."""
    width = (high - low) / bins
    v = F.col(value)
    cell = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where((v >= low) & (v <= high)).groupBy(*keys, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    dense = every.join(counts, [*keys, "bin"], "left")
    return dense.select(*keys, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (low + F.col("bin") * width).alias("edge"))


def merge_histograms(counts: DataFrame) -> DataFrame:
    """Sum of histograms by bin; bins that disagree about their edge are an error."""
    edges = F.max("edge") != F.min("edge")
    return counts.groupBy("bin").agg(
        F.sum("n").alias("n"), F.when(edges, F.raise_error(F.lit("bin edges differ"))).otherwise(F.min("edge")).cast("double").alias("edge")
    )


def label_share(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows of each label of each group, and their share of the group."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def label_summary(shares: DataFrame, label: str) -> DataFrame:
    """Mean share of each label over the groups in which it is present."""
    return shares.groupBy(label).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"), F.avg("share").alias("mean_share"))


def bounding_box(df: DataFrame, keys: list[str], axes: list[str], where: Column) -> DataFrame:
    """Least and greatest-plus-one coordinate of each axis over the rows that satisfy ``where``."""
    ends = [e for a in axes for e in (F.min(a).alias(f"{a}_start"), (F.max(a) + 1).alias(f"{a}_end"))]
    return df.where(where).groupBy(*keys).agg(*ends)


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable count, sum and sum of squares, and the mean and deviation that they give."""
    v = F.col(value)
    sums = df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_sq"))
    mean = F.col("sum") / F.col("n")
    return sums.withColumns({"mean": mean, "std": F.sqrt(F.greatest(F.col("sum_sq") / F.col("n") - mean * mean, F.lit(0.0)))})


def target_spacing(df: DataFrame, axes: list[str], ratio: float = 3.0, percentile: float = 0.1) -> DataFrame:
    """Median spacing of each axis; the coarsest axis takes a low percentile if spacings differ by ``ratio``."""
    sums = df.agg(*[F.median(a).alias(a) for a in axes], *[F.percentile(a, percentile).alias(f"{a}_low") for a in axes])
    high, low = F.greatest(*axes), F.least(*axes)
    uneven = high / low >= ratio
    return sums.select(*[F.when(uneven & (F.col(a) == high), F.greatest(F.col(f"{a}_low"), low)).otherwise(F.col(a)).alias(a) for a in axes])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: list[float], name: str = "e__") -> DataFrame:
    """(keys, ``name``): the interpolated percentiles of each group as an array, null values left out, as ``percentile`` gives them.

    ``percentile`` holds a group's distinct values in one task.  Here they are counted, dealt into ranges of their
    order and summed up along it, so no task sees more than its range, and each group picks two values a percentile.
    A group without a value has no row."""
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*[F.col(k) for k in keys], v.cast("double").alias("v__")).agg(F.count(F.lit(1)).alias("n__"))
    rows = saved(with_running_sums(counts, F.struct(*keys, "v__"), {"upto__": "n__"}))
    sizes = saved(rows.groupBy(*[F.col(k).alias(f"{k}__") for k in keys]).agg(F.min(F.col("upto__") - F.col("n__")).alias("from__"), F.sum("n__").alias("size__")))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    both = rows.join(sizes, on).withColumn("last__", F.col("upto__") - F.col("from__"))  # ranks from last - n up to last - 1
    at = [(F.col("size__") - 1) * F.lit(float(q)) for q in fractions]
    holds = lambda rank: (rank < F.col("last__")) & (rank >= F.col("last__") - F.col("n__"))
    ends = [F.max(F.when(holds(edge(p)), F.col("v__"))).alias(f"{side}{i}__") for i, p in enumerate(at) for side, edge in (("low", F.floor), ("high", F.ceil))]
    wanted = F.lit(False)
    for p in at:
        wanted = wanted | holds(F.floor(p)) | holds(F.ceil(p))
    found = both.where(wanted).groupBy(*keys).agg(F.first("size__").alias("size__"), *ends)
    between = []
    for i, p in enumerate(at):
        low, high = F.col(f"low{i}__"), F.col(f"high{i}__")
        between.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    return saved(found.select(*keys, F.array(*between).alias(name)))
