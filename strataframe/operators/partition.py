"""Splitting, stratifying, resampling and weighted picking of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.core.storage import saved, with_row_index


def hash_order(seed: int, *columns: str) -> Column:
    """A shuffled order that every engine can repeat: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_unit(seed: int, *columns: str | Column) -> Column:
    """A number in [0, 1) for each row, by the same md5: alike on every run and in every engine."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def round_robin(df: DataFrame, parts: int, *order: str | Column) -> DataFrame:
    """Part of each row when rows in order are dealt in turn."""
    return with_row_index(df, *order).withColumn("part", F.pmod("row_index", F.lit(parts)).cast("int"))


def ratio_cuts(n: int, ratios: list[float]) -> list[int]:
    """Ends of parts: each takes its share of n, rounded half up, as long as rows are left."""
    ends, start, total = [], 0, sum(ratios)
    for r in ratios:
        start = min(start + int(r / total * n + 0.5), n)
        ends.append(start)
    return ends


def by_ratio(df: DataFrame, ratios: list[float], *order: str | Column) -> DataFrame:
    """Contiguous parts in the given ratios; rows beyond the last cut belong to no part."""
    indexed = with_row_index(df, *order)
    ends = ratio_cuts(df.count(), ratios)
    part = None
    for i, end in enumerate(ends):
        part = F.when(F.col("row_index") < end, i) if part is None else part.when(F.col("row_index") < end, i)
    return indexed.withColumn("part", part.cast("int")).where("part is not null")


def even_padded(df: DataFrame, parts: int, *order: str | Column) -> DataFrame:
    """Round robin after padding with the first rows, so that all parts are equally long."""
    indexed = with_row_index(df, *order)
    n = df.count()
    pad = -n % parts
    again = indexed.where(F.col("row_index") < pad).withColumn("row_index", F.col("row_index") + n)
    return indexed.union(again).withColumn("part", F.pmod("row_index", F.lit(parts)).cast("int"))


def stratified(df: DataFrame, label: str, parts: int, *order: str | Column) -> DataFrame:
    """Deals the rows of each class in turn, so that each part has its share of each class.

    A hot class would be one window; its places come from sub-ranges of its rows instead."""
    indexed = with_row_index(df, label, *order)
    first = indexed.groupBy(F.col(label).alias("label__")).agg(F.min("row_index").alias("first__"))
    both = indexed.join(first, F.col(label).eqNullSafe(F.col("label__")))
    return both.withColumn("part", F.pmod(F.col("row_index") - F.col("first__"), F.lit(parts)).cast("int")).drop("label__", "first__")


def resample(df: DataFrame, factor: float, *order: str | Column) -> DataFrame:
    """The table floor(factor) times, and the leading part of it for the rest; ``copy`` counts from 0."""
    whole, rest = int(factor), factor - int(factor)
    cut = ratio_cuts(df.count(), [rest, 1 - rest])[0] if rest else 0
    copies = F.lit(whole) + F.when(F.col("row_index") < cut, 1).otherwise(0)
    indexed = with_row_index(df, *order).withColumn("copies__", copies).where("copies__ > 0")
    return indexed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies__") - 1))).drop("copies__")


def folds(df: DataFrame, k: int, chosen: list[int], *order: str | Column) -> DataFrame:
    """Rows of the chosen ones of k folds."""
    return round_robin(df, k, *order).where(F.col("part").isin(chosen))


def weighted_pick(df: DataFrame, weight: str, draws: int, *order: str, seed: int = 0) -> DataFrame:
    """For each draw the first row whose cumulative weight exceeds its point.

    Negative weights are shifted by the least; if all are zero, each row weighs the same.  The points
    are fractions made of the md5 of seed and draw, so a draw is alike on every run."""
    low, total, n = df.agg(F.min(weight), F.sum(weight), F.count(F.lit(1))).first()
    shift = -low if low is not None and low < 0 else 0.0
    even = (total or 0) + shift * (n or 0) <= 0
    value = F.lit(1.0) if even else F.col(weight) + shift
    whole = float(n if even else total + shift * n) if n else 0.0
    indexed = with_row_index(df.withColumn("w__", value), *order)
    block = F.floor(F.col("row_index") / 4096)
    sums = indexed.groupBy(block.alias("b__")).agg(F.sum("w__").alias("s__"))
    before = Window.orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("b__", F.coalesce(F.sum("s__").over(before), F.lit(0.0)).alias("start__"))
    within = Window.partitionBy("b__").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    summed = indexed.withColumn("b__", block).join(starts, "b__").withColumn("high__", F.col("start__") + F.sum("w__").over(within))
    points = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string")))
    point = F.conv(F.substring(text, 1, 12), 16, 10).cast("double") / float(1 << 48) * whole
    rows = summed.withColumn("low__", F.col("high__") - F.col("w__"))
    # A point's block is found among the blocks' borders; then draws and rows meet by equality.
    borders = starts.join(sums, "b__").select("b__", F.col("start__").alias("from__"), (F.col("start__") + F.col("s__")).alias("to__"))
    cell = whole / 4096 or 1.0
    near = F.explode(F.sequence(F.floor(F.col("from__") / cell), F.floor(F.col("to__") / cell)))
    dealt = points.withColumn("point", point).withColumn("c__", F.floor(F.col("point") / cell)).join(borders.withColumn("c__", near), "c__")
    placed = dealt.where((F.col("from__") <= F.col("point")) & (F.col("point") < F.col("to__"))).select("draw", "point", "b__")
    picked = placed.join(rows, "b__").where((F.col("low__") <= F.col("point")) & (F.col("point") < F.col("high__")))
    return picked.drop("b__", "start__", "low__", "high__", "w__")


def weighted_sample(df: DataFrame, weight: str, count: int, *key: str, seed: int = 0) -> DataFrame:
    """``count`` different rows, drawn without replacement with chances by ``weight``, and their ``sample_key``.

    Each row gets -ln(u) / weight, u being its hash by seed and key, and the least keys win, as if rows were
    drawn one after another by the weights of those left.  Two quantiles bracket the last key that wins: exact
    counts tell how many lie below, and only rows within the bracket are put in order; if a count shows
    that the bracket misses the last key, all rows are.  Null, zero and negative weights are never drawn;
    fewer rows than ``count`` are all taken; equal keys fall to the lesser ``key``; reruns agree."""
    value = F.col(weight).cast("double")
    unit = hash_unit(seed, *key) + 2.0**-53  # never zero
    rows = saved(df.where(value > 0).withColumn("sample_key", -F.log(unit) / value))
    n = rows.count()
    if n <= count:
        return rows
    part, slack = count / n, max(1e-3, 2 / n)
    low, high = rows.agg(F.percentile_approx("sample_key", F.array(F.lit(max(0.0, part - slack)), F.lit(min(1.0, part + slack))), F.lit(10_000))).first()[0]
    below, within = rows.agg(F.count_if(F.col("sample_key") < low), F.count_if(F.col("sample_key") <= high)).first()
    if not below <= count <= within:
        below, low, high = 0, float("-inf"), float("inf")
    bracket = with_row_index(rows.where(F.col("sample_key").between(low, high)), "sample_key", *key, name="place__")
    return rows.where(F.col("sample_key") < low).unionByName(bracket.where(F.col("place__") < count - below).drop("place__"))
