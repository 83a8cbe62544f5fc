"""Array operators as column expressions: padding, cropping, flipping, activations and index maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_to(array: Column, size: int, value: float = 0.0, symmetric: bool = True) -> Column:
    """Padded to ``size``; the odd element of a symmetric pad goes to the end.  Longer arrays stay."""
    missing = F.greatest(F.lit(size) - F.size(array), F.lit(0))
    before = F.floor(missing / 2).cast("int") if symmetric else F.lit(0)
    fill = lambda n: F.array_repeat(F.lit(value), n)
    return F.concat(fill(before), array, fill(missing - before))


def center_crop(array: Column, size: int) -> Column:
    """The middle ``size`` elements; shorter arrays stay."""
    n = F.size(array)
    start = F.greatest(F.floor(n / 2) - size // 2, F.lit(0)).cast("int")
    return F.when(n <= size, array).otherwise(F.slice(array, start + 1, F.lit(size)))


def crop(array: Column, start: int, end: int) -> Column:
    return F.slice(array, start + 1, max(end - start, 0))


def flip(array: Column) -> Column:
    return F.reverse(array)


def softmax(array: Column) -> Column:
    top = F.array_max(array)
    powers = F.transform(array, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def argmax(array: Column) -> Column:
    """Place of the greatest element from 0; the first of equal ones."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def one_hot(place: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == place).cast("int"))


def unravel(index: Column, shape: list[int]) -> list[Column]:
    """Coordinates of a flat row-major index."""
    out, step = [], 1
    for n in reversed(shape):
        out.append(F.floor(index / step).cast("long") % n)
        step *= n
    return out[::-1]


def ravel(coordinates: list[Column], shape: list[int]) -> Column:
    total = F.lit(0)
    for c, n in zip(coordinates, shape, strict=True):
        total = total * n + c
    return total


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cumulative_sum(array: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["out"], acc["s"] + x).alias("out"))
    return F.aggregate(array, start, step)["out"]


def minmax(array: Column) -> Column:
    """Elements rescaled to [0, 1]; a constant array becomes zeros."""
    low, high = F.array_min(array), F.array_max(array)
    return F.transform(array, lambda x: F.when(high == low, F.lit(0.0)).otherwise((x - low) / (high - low)))
