"""Mixing pairs of rows: each row gets a partner by a shuffled order, and arrays are blended with the partner's."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.core.storage import with_row_index
from strataframe.operators.partition import hash_order, hash_unit


def paired(df: DataFrame, key: str, seed: int, suffix: str = "_other") -> DataFrame:
    """Each row beside another (or itself): the i-th row in order of ``key`` and the i-th in a shuffled order.

    Both orders are distributed sorts, and the partners meet by an equality join on the place.  A null key
    sorts first; of rows with one key, which comes first isn't defined."""
    ordered = with_row_index(df, key, name="i__")
    shuffled = with_row_index(df, hash_order(seed, key), F.col(key), name="i__")
    other = shuffled.select("i__", *[F.col(f"`{c}`").alias(f"{c}{suffix}") for c in df.columns])
    return ordered.join(other, "i__").drop("i__")


def mix_up(a: Column, b: Column, weight: Column) -> Column:
    """``weight * a + (1 - weight) * b``, element by element; null where an array is shorter."""
    return F.zip_with(a, b, lambda x, y: weight * x + (1.0 - weight) * y)


def _start(size: Sequence[int], share: Column, keys: Sequence[str | Column], seed: int) -> list[tuple[Column, Column]]:
    """Ends of a box that holds about ``share`` of an image, about a middle drawn for each row."""
    side = F.pow(share, F.lit(1.0 / len(size)))
    ends = []
    for axis, n in enumerate(size):
        half = F.floor(side * n / 2)
        middle = F.floor(hash_unit(seed + axis, *keys) * n)
        ends.append((F.greatest(middle - half, F.lit(0)), F.least(middle + half, F.lit(n))))
    return ends


def _inside(k: Column, size: Sequence[int], ends: Sequence[tuple[Column, Column]]) -> Column:
    inside, rest = F.lit(True), k
    for n, (low, high) in reversed(list(zip(size, ends, strict=True))):
        inside = inside & (rest % n >= low) & (rest % n < high)
        rest = F.floor(rest / n)
    return inside


def cut_mix(a: Column, b: Column, size: Sequence[int], weight: Column, seed: int, *keys: str | Column) -> Column:
    """``a`` with a box of about ``1 - weight`` of the image taken from ``b`` (flat images, last axis first).

    A box that passes the border is cut there; middles come from a hash of the keys, so reruns agree."""
    ends = _start(size, 1.0 - weight, keys, seed)
    return F.transform(a, lambda x, k: F.when(_inside(k, size, ends), F.get(b, k)).otherwise(x))


def cut_out(a: Column, size: Sequence[int], share: float, seed: int, *keys: str | Column, fill: float = 0.0) -> Column:
    """``a`` with a box of about ``share`` of the image set to ``fill``."""
    ends = _start(size, F.lit(float(share)), keys, seed)
    return F.transform(a, lambda x, k: F.when(_inside(k, size, ends), F.lit(fill)).otherwise(x))


def kept_share(size: Sequence[int], weight: Column, seed: int, *keys: str | Column) -> Column:
    """The share of ``a`` that ``cut_mix`` leaves, by which labels are mixed."""
    cells = F.lit(1.0)
    for low, high in _start(size, 1.0 - weight, keys, seed):
        cells = cells * F.greatest(high - low, F.lit(0))
    return 1.0 - cells / float(math.prod(size))
