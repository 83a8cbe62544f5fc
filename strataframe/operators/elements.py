"""Functions of numbers and arrays as column expressions: no Python runs for any of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def floor_divide(a: Column, b: Column) -> Column:
    """Quotient rounded down; null where b is 0."""
    return F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def clip(values: Column, low: float, high: float) -> Column:
    return F.transform(values, lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def searchsorted(ordered: Column, value: Column, right: bool = False) -> Column:
    """Place at which ``value`` keeps the array in order: before equal ones, or after them."""
    return F.size(F.filter(ordered, lambda v: v <= value if right else v < value))


def nonzero(values: Column) -> Column:
    """Places of the elements other than 0; null and NaN elements aren't 0."""
    places = F.transform(values, lambda v, i: F.when(v.isNull() | (v != 0), i))
    return F.filter(places, lambda i: i.isNotNull())


def argsort(values: Column) -> Column:
    """Places of the elements in ascending order, equal ones as they stand."""
    return F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda x: x["i"])


def repeat(values: Column, times: int) -> Column:
    """Each element ``times`` times in a row."""
    return F.flatten(F.transform(values, lambda v: F.array_repeat(v, times)))


def remove_repeated(values: Column, times: int) -> Column:
    """The first of each ``times`` elements: undoes ``repeat``."""
    return F.filter(values, lambda v, i: i % times == 0)


def stack(*arrays: Column) -> Column:
    """Arrays as rows of one."""
    return F.array(*arrays)


def swap_axes(rows: Column) -> Column:
    """Rows of equal length as columns: the last axis of two becomes the first."""
    width = F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda j: F.transform(rows, lambda r: F.get(r, j)))


def unique(values: Column) -> Column:
    """Distinct elements in order."""
    return F.array_sort(F.array_distinct(values))


def mode(values: Column) -> Column:
    """The most frequent element, the least of equally frequent ones."""
    ordered = F.array_sort(values)
    first = F.get(ordered, F.lit(0))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["at"], s["run"] + 1).otherwise(1)
        return F.struct(F.when(run > s["n"], x).otherwise(s["best"]).alias("best"), F.greatest(run, s["n"]).alias("n"), x.alias("at"), run.alias("run"))

    start = F.struct(first.alias("best"), F.lit(0).alias("n"), first.alias("at"), F.lit(0).alias("run"))
    return F.aggregate(ordered, start, step)["best"]


def is_in(values: Column, chosen: Sequence) -> Column:
    """For each element whether it's among ``chosen``."""
    return F.transform(values, lambda v: v.isin(*chosen))


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether arrays have equal length and |a - b| <= atol + rtol |b| everywhere."""
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda ok: F.coalesce(ok, F.lit(False)))


def percentile(values: Column, q: float) -> Column:
    """Percentile by linear interpolation between neighbours; null for an empty array."""
    ordered, place = F.array_sort(values), (F.size(values) - 1) * q / 100.0
    low = F.floor(place).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) > 0, a + (b - a) * (place - low))


def mask_values(values: Column, mask: Column) -> Column:
    """Elements where the mask is above 0, and 0 elsewhere."""
    return F.zip_with(values, mask, lambda v, m: F.when(m > 0, v).otherwise(F.lit(0).cast("double")))


def label_filter(labels: Column, chosen: Sequence[int]) -> Column:
    """Labels among ``chosen``; others become 0."""
    return F.transform(labels, lambda v: F.when(v.isin(*chosen), v).otherwise(F.lit(0)))


def foreground(values: Column, threshold: float, invert: bool = False) -> Column:
    """1 where a value is above the threshold (or, inverted, at most at it), else 0."""
    return F.transform(values, lambda v: ((v <= threshold) if invert else (v > threshold)).cast("int"))


def brats_channels(labels: Column) -> Column:
    """Three channels of 0 and 1 from tumour labels: core (1, 4), whole (1, 2, 4), enhancing (4)."""
    return F.array(*[F.transform(is_in(labels, chosen), lambda v: v.cast("int")) for chosen in ((1, 4), (1, 2, 4), (4,))])


def channel_last(channels: Column) -> Column:
    """Channels of equal length as one row of channel values for each place."""
    return swap_axes(channels)


def summary(values: Column) -> dict[str, Column]:
    """max, mean, min, sum and population std of an array; null for an empty one."""
    n, total = F.size(values), F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    mean = F.when(n > 0, total / n)
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return {"max": F.array_max(values), "mean": mean, "min": F.array_min(values), "sum": F.when(n > 0, total), "std": F.when(n > 0, F.sqrt(squares / n))}


def label_quality(pred: Column, truth: Column, reduction: str = "sum") -> Column:
    """How far a prediction lies from its label: |pred - truth|, summed, averaged or (``none``) as it is.

    Null if an array is null or holds a null; arrays of unequal length are null too.  Empty arrays
    sum to zero and have no mean."""
    gaps = F.when(F.size(pred) == F.size(truth), F.zip_with(pred, truth, lambda a, b: F.abs(a - b)))
    if reduction == "none":
        return gaps
    total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    if reduction == "sum":
        return total
    if reduction == "mean":
        return F.when(F.size(gaps) > 0, total / F.size(gaps))
    raise ValueError(f"unknown reduction {reduction!r}")
