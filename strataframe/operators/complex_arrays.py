"""Complex numbers and k-space: arrays of structs ``(re, im)``, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators.partition import hash_unit


def number(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def from_pairs(values: Column) -> Column:
    """A flat array re, im, re, im, … as complex numbers; a last single number has no imaginary part."""
    pairs = F.transform(values, lambda v, i: F.when(i % 2 == 0, number(v, F.coalesce(F.get(values, i + 1), F.lit(0.0)))))
    return F.filter(pairs, lambda z: z.isNotNull())


def to_pairs(z: Column) -> Column:
    return F.flatten(F.transform(z, lambda x: F.array(x["re"], x["im"])))


def to_channels(z: Column) -> Column:
    """Real parts, then imaginary parts, as two channels."""
    return F.array(F.transform(z, lambda x: x["re"]), F.transform(z, lambda x: x["im"]))


def from_channels(channels: Column) -> Column:
    """Undoes ``to_channels``; channels of different lengths give null numbers at the end."""
    return F.zip_with(F.get(channels, F.lit(0)), F.get(channels, F.lit(1)), number)


def magnitude(z: Column) -> Column:
    return F.transform(z, lambda x: F.hypot(x["re"], x["im"]))


def conjugate(z: Column) -> Column:
    return F.transform(z, lambda x: number(x["re"], -x["im"]))


def multiply(a: Column, b: Column) -> Column:
    """Element by element; null where one array has no element."""
    return F.zip_with(a, b, lambda x, y: number(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"]))


def root_sum_of_squares(df: DataFrame, keys: Sequence[str], place: str, value: str) -> DataFrame:
    """Root of the sum of squared magnitudes over coils: rows that agree on keys and place."""
    square = F.pow(F.col(f"{value}.re"), 2) + F.pow(F.col(f"{value}.im"), 2)
    return df.groupBy(*keys, place).agg(F.sqrt(F.sum(square)).alias("rss"))


def expand(df: DataFrame, maps: DataFrame, keys: Sequence[str], place: str, value: str, weight: str) -> DataFrame:
    """One image seen through each coil: the product of the value and the coil's sensitivity at the place.

    An equality join on keys and place; coils multiply the rows."""
    both = df.join(maps, [*keys, place])
    a, b = F.col(value), F.col(weight)
    made = number(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])
    return both.withColumn(value, made).drop(weight)


def reduce_coils(df: DataFrame, maps: DataFrame, keys: Sequence[str], coil: str, place: str, value: str, weight: str) -> DataFrame:
    """All coils as one image: sum of values times conjugate sensitivities."""
    both = df.join(maps, [*keys, coil, place])
    a, b = F.col(value), F.col(weight)
    re, im = a["re"] * b["re"] + a["im"] * b["im"], a["im"] * b["re"] - a["re"] * b["im"]
    return both.groupBy(*keys, place).agg(number(F.sum(re), F.sum(im)).alias(value))


def normalize(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Real and imaginary parts of each group less their mean, over their population deviation (null if it is 0)."""
    parts = {p: F.col(f"{value}.{p}") for p in ("re", "im")}
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"{n}_{p}__") for p, c in parts.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    made = [F.try_divide(c - F.col(f"mean_{p}__"), F.nullif(F.col(f"std_{p}__"), F.lit(0.0))) for p, c in parts.items()]
    return df.join(stats, list(keys)).withColumn(value, number(*made)).drop(*[f"{n}_{p}__" for p in parts for n in ("mean", "std")])


def _center(columns: int, share: float) -> tuple[int, int]:
    low = round(columns * share)
    start = (columns - low + 1) // 2
    return start, low


def random_mask(column: Column, columns: int, share: float, acceleration: float, seed: int, *identity: str | Column) -> Column:
    """Whether a column of k-space is sampled: the central ``share`` always, others by a hash of seed, row and column.

    About columns / acceleration of them are; reruns agree."""
    start, low = _center(columns, share)
    chance = (columns / acceleration - low) / (columns - low) if low < columns else 1.0
    return ((column >= start) & (column < start + low)) | (hash_unit(seed, *identity, column) < chance)


def even_mask(column: Column, columns: int, share: float, acceleration: float, offset: int = 0) -> Column:
    """Whether a column of k-space is sampled: the central ``share``, and others at even steps from ``offset``.

    Steps are such that about columns / acceleration columns are taken in all; where the centre alone is more
    than that, only the centre is."""
    start, low = _center(columns, share)
    center = (column >= start) & (column < start + low)
    if low * acceleration >= columns:
        return center
    step = acceleration * (low - columns) / (low * acceleration - columns)
    exact = (offset + k * step for k in range(columns))
    places = [round(x) for x in exact if x < columns - 1]
    return center | column.isin(places)


def complex_distance(a: Column, b: Column) -> Column:
    """Largest distance between elements of two complex arrays."""
    apart = F.zip_with(a, b, lambda x, y: F.hypot(x["re"] - y["re"], x["im"] - y["im"]))
    return F.array_max(apart)
