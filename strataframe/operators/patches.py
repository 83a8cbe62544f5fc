"""Splitting arrays into patches, merging them, and turning labels into masks, places and channels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.volumes import Kernel, center_crop, spatial_pad


def starts(n: int, size: int, overlap: float | int) -> list[int]:
    """Starts of patches along an axis; an integer overlap counts places, a float is a share (half to even)."""
    step = size - overlap if isinstance(overlap, int) else round(size * (1 - overlap))
    return list(range(0, max(n - size, 0) + 1, max(step, 1)))


def window_starts(n: int, size: int, overlap: float) -> list[int]:
    """Starts of scoring windows: the last is shifted back inside."""
    step = max(int(size * (1 - overlap)), 1)
    count = max(-(-(n - size) // step), 0) + 1
    return sorted({min(i * step, max(n - size, 0)) for i in range(count)})


def explode_patches(df: DataFrame, size: Sequence[int], overlap: float = 0.0, keys: Sequence[str] = ("id",), shape: str = "shape", values: str = "values", inside: bool = True) -> DataFrame:
    """A row for each patch of each array: keys, ``at`` (its start), ``size`` and ``patch`` values.

    ``inside``: the last windows are shifted back inside, as for scoring; else what doesn't fill a patch is left out."""
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

    schema = StructType([df.schema[k] for k in keys] + [StructField("at", ArrayType(IntegerType())), StructField("size", ArrayType(IntegerType())), StructField("patch", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (s, v) in enumerate(zip(batch.column(shape).to_pylist(), batch.column(values).to_pylist(), strict=True)):
                if s is None or v is None:
                    continue
                x = np.asarray(v, float).reshape(s)
                real = [min(a, b) for a, b in zip(size, s, strict=True)]
                spots = list(product(*[(window_starts if inside else starts)(n, m, overlap) for n, m in zip(s, real, strict=True)]))
                own = [pa.array(batch.column(k).slice(i, 1).to_pylist() * len(spots), batch.schema.field(k).type) for k in keys]
                cut = [x[tuple(slice(a, a + m) for a, m in zip(p, real, strict=True))].ravel() for p in spots]
                yield pa.RecordBatch.from_arrays([*own, pa.array([list(p) for p in spots], pa.list_(pa.int32())), pa.array([real] * len(spots), pa.list_(pa.int32())), pa.array(cut, pa.list_(pa.float64()))], names=[*keys, "at", "size", "patch"])

    return df.mapInArrow(run, schema)


def importance(size: Sequence[int], sigma_scale: float = 0.125) -> np.ndarray:
    """Gaussian weights of a window, never quite zero."""
    out = np.ones(())
    for n in size:
        line = np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / (n * sigma_scale)) ** 2)
        out = np.multiply.outer(out, line)
    return np.maximum(out, out[out > 0].min() if (out > 0).any() else 1.0)


def merge_patches(patched: DataFrame, keys: Sequence[str], shapes: DataFrame, gaussian: bool = False) -> DataFrame:
    """Patches averaged over each place of each array: keys, ``shape`` and ``values``.

    Each patch becomes flat places with weights, summed by place natively, so an array is never one
    task's work until its places are put in order.  ``shapes`` has keys and ``shape``; places without
    a patch are NaN."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    both = patched.join(shapes.select(*keys, "shape"), list(keys))
    cell = StructType([both.schema[k] for k in keys] + [StructField(n, ArrayType(t)) for n, t in (("place", LongType()), ("w", DoubleType()), ("wx", DoubleType()))])

    def run(batches):
        for batch in batches:
            places, weights, sums = [], [], []
            for at, size, patch, s in zip(*(batch.column(c).to_pylist() for c in ("at", "size", "patch", "shape")), strict=True):
                grid = np.meshgrid(*[np.arange(a, a + m) for a, m in zip(at, size, strict=True)], indexing="ij")
                w = (importance(size) if gaussian else np.ones(size)).ravel()
                x = np.asarray(patch, float)
                ok = ~np.isnan(x)
                places.append(np.ravel_multi_index([g.ravel() for g in grid], s)[ok])
                weights.append(w[ok])
                sums.append((w * x)[ok])
            own = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64())), pa.array(sums, pa.list_(pa.float64()))], names=[*keys, "place", "w", "wx"])

    cells = both.mapInArrow(run, cell).select(*keys, F.explode(F.arrays_zip("place", "w", "wx")).alias("c")).select(*keys, "c.*")
    mean = cells.groupBy(*keys, "place").agg((F.sum("wx") / F.sum("w")).alias("v"))
    lists = mean.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, b: a * b)
    ordered = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(float("nan"))))
    return shapes.select(*keys, "shape").join(lists, list(keys)).select(*keys, "shape", ordered.alias("values"))


def grid_split(grid: Sequence[int]) -> Callable[[np.ndarray], list[np.ndarray]]:
    """Cells of an even grid; what doesn't divide is left out at the end."""

    def run(x):
        step = [n // g for n, g in zip(x.shape, grid, strict=True)]
        return [x[tuple(slice(i * s, (i + 1) * s) for i, s in zip(at, step, strict=True))] for at in np.ndindex(*grid)]

    return run


def pad_or_crop(size: Sequence[int]) -> Kernel:
    return lambda x: center_crop(size)(spatial_pad(size)(x))


def coordinate_channels() -> Kernel:
    """Normalised coordinates of each axis from -0.5 to 0.5, stacked after the array (channel first)."""

    def run(x):
        axes = np.meshgrid(*[np.linspace(-0.5, 0.5, n) for n in x.shape[1:]], indexing="ij")
        return np.concatenate([x, np.stack(axes)])

    return run


def label_mask(labels: Sequence[float], merge: bool = True) -> Kernel:
    """Ones where the label is selected; merged over channels, or for each of them."""
    return lambda x: np.isin(x, labels).any(0, keepdims=True).astype(float) if merge else np.isin(x, labels).astype(float)


def one_hot(classes: int) -> Kernel:
    """Channels of each class of a label array without channels."""
    return lambda x: (np.arange(classes).reshape(-1, *[1] * x.ndim) == x).astype(float)


def class_places(x: np.ndarray, classes: int, most: int | None = None) -> list[np.ndarray]:
    """Flat places of each class; an even choice of at most ``most``."""
    found = [np.flatnonzero(x.ravel() == c) for c in range(classes)]
    return [f if most is None or len(f) <= most else f[np.rint(np.linspace(0, len(f) - 1, most)).astype(int)] for f in found]


def probability_peaks(threshold: float, box: int) -> Callable[[np.ndarray], list[tuple]]:
    """Greatest values above a threshold one after another, each clearing a box around it."""

    def run(x):
        x, found = x.copy(), []
        while x.size and (top := x.max()) > threshold:
            at = np.unravel_index(int(x.argmax()), x.shape)
            found.append((float(top), *map(int, at)))
            x[tuple(slice(max(a - box // 2, 0), a + box - box // 2) for a in at)] = -np.inf
        return found

    return run


def interpolation_points(points: np.ndarray, matrix: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Points mapped by a homogeneous matrix."""
    m = np.linalg.inv(matrix) if inverse else np.asarray(matrix)
    return points @ m[:-1, :-1].T + m[:-1, -1]


def to_corner_points(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All corners of a box, and back by their extremes."""
    return np.array(list(product(*zip(low, high, strict=True))))
