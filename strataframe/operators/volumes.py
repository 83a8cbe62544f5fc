"""Array operators that columns can't express: kernels on numpy arrays, applied to rows of arrays.

A row holds ``shape array<int>`` and flat ``values array<double>`` in row-major order, channel first
where a kernel says so.  ``apply`` runs a kernel over Arrow batches, one row's array at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Kernel = Callable[[np.ndarray], np.ndarray]


def apply(df: DataFrame, kernel: Kernel, shape: str = "shape", values: str = "values") -> DataFrame:
    """``df`` with each row's array replaced by the kernel's; rows with a null array stay null."""
    names = df.columns

    def run(batches):
        for batch in batches:
            shapes, flats = [], []
            for s, v in zip(batch.column(shape).to_pylist(), batch.column(values).to_pylist(), strict=True):
                out = None if s is None or v is None else kernel(np.asarray(v, float).reshape(s))
                shapes.append(None if out is None else list(out.shape))
                flats.append(None if out is None else out.astype(float).ravel())
            made = {shape: pa.array(shapes, pa.list_(pa.int32())), values: pa.array(flats, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in names], names=names)

    return df.mapInArrow(run, df.schema)


def known_keys(df: DataFrame, keys: Sequence[str], allow_missing: bool) -> list[str]:
    missing = [k for k in keys if k not in df.columns]
    if missing and not allow_missing:
        raise KeyError(f"columns are missing: {missing}")
    return [k for k in keys if k in df.columns]


def struct_arrays(column: pa.StructArray) -> list[np.ndarray | None]:
    """The arrays of a column ``struct<shape array<int>, values array<double>>``, null where any part is."""
    out = []
    for row in column:
        s, v = (None, None) if not row.is_valid else (row["shape"].as_py(), row["values"])
        out.append(None if s is None or not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(float).reshape(s))
    return out


def array_structs(arrays: Sequence[np.ndarray | None]) -> pa.StructArray:
    shapes = pa.array([None if x is None else list(x.shape) for x in arrays], pa.list_(pa.int32()))
    flats = pa.array([None if x is None else x.astype(float).ravel() for x in arrays], pa.list_(pa.float64()))
    return pa.StructArray.from_arrays([shapes, flats], ["shape", "values"], mask=pa.array([x is None for x in arrays], pa.bool_()))


def apply_keys(df: DataFrame, kernel: Kernel | dict[str, Kernel], keys: Sequence[str], allow_missing: bool = False) -> DataFrame:
    """``df`` with the arrays of all ``keys`` replaced, in one pass over the rows.

    A key is a column ``struct<shape array<int>, values array<double>>``; ``kernel`` is one for all
    keys or one for each (an image drawn linearly, its labels by the nearest).  Null arrays stay null;
    an absent key is an error, or skipped with ``allow_missing``."""
    found, names = known_keys(df, keys, allow_missing), df.columns
    chosen = {k: kernel[k] if isinstance(kernel, dict) else kernel for k in found}

    def run(batches):
        for batch in batches:
            made = {k: array_structs([None if x is None else f(x) for x in struct_arrays(batch.column(k))]) for k, f in chosen.items()}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in names], names=names)

    return df.mapInArrow(run, df.schema) if chosen else df


def measure(df: DataFrame, metric: Callable[[np.ndarray, np.ndarray], float], a: str = "pred", b: str = "truth", shape: str = "shape", name: str = "metric") -> DataFrame:
    """``df`` with a number for each row's pair of arrays of one shape."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for batch in batches:
            out = []
            for s, x, y in zip(*(batch.column(c).to_pylist() for c in (shape, a, b)), strict=True):
                value = None if None in (s, x, y) else float(metric(np.asarray(x, float).reshape(s), np.asarray(y, float).reshape(s)))
                out.append(None if value is None or np.isnan(value) else value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


# --- shapes ---


def rotate90(turns: int = 1, axes: tuple[int, int] = (0, 1)) -> Kernel:
    return lambda x: np.rot90(x, turns, axes)


def flip(axes: Sequence[int]) -> Kernel:
    return lambda x: np.flip(x, axes)


def transpose(order: Sequence[int]) -> Kernel:
    return lambda x: x.transpose(order)


def spatial_pad(size: Sequence[int], mode: str = "constant", value: float = 0.0) -> Kernel:
    """Padded on both sides to at least ``size``; the odd element goes to the end."""

    def run(x):
        missing = [max(n - m, 0) for n, m in zip(size, x.shape, strict=True)]
        width = [(m // 2, m - m // 2) for m in missing]
        return np.pad(x, width, mode, **({"constant_values": value} if mode == "constant" else {}))

    return run


def divisible_pad(k: int) -> Kernel:
    return lambda x: spatial_pad([-(-n // k) * k for n in x.shape])(x)


def center_crop(size: Sequence[int]) -> Kernel:
    def run(x):
        cut = []
        for n, m in zip(x.shape, size, strict=True):
            start = max(n // 2 - m // 2, 0)
            cut.append(slice(start, start + m) if m < n else slice(None))
        return x[tuple(cut)]

    return run


def foreground_crop(above: float = 0.0, margin: int = 0) -> Kernel:
    """The bounding box of values above a limit, with a margin inside the array; nothing above keeps nothing."""

    def run(x):
        at = np.argwhere(x > above)
        if not len(at):
            return x[tuple(slice(0, 0) for _ in x.shape)]
        low, high = np.maximum(at.min(0) - margin, 0), np.minimum(at.max(0) + 1 + margin, x.shape)
        return x[tuple(slice(a, b) for a, b in zip(low, high, strict=True))]

    return run


# --- resampling ---


def _sample(x: np.ndarray, points: np.ndarray, linear: bool, padding: str) -> np.ndarray:
    """Values at fractional places (axis first); outside is the border, or zero."""
    ndim = x.ndim
    limit = np.array(x.shape).reshape(-1, *[1] * (points.ndim - 1)) - 1
    inside = ((points > -0.5) & (points < limit + 0.5)).all(0) if padding == "zeros" else True
    points = np.clip(points, 0, limit)
    if not linear:
        out = x[tuple(np.rint(points).astype(int))]
        return np.where(inside, out, 0.0)
    low = np.minimum(np.floor(points).astype(int), np.maximum(limit - 1, 0))
    part, out = points - low, 0.0
    for corner in product((0, 1), repeat=ndim):
        at = tuple(np.minimum(low[i] + c, x.shape[i] - 1) for i, c in enumerate(corner))
        weight = np.prod([part[i] if c else 1 - part[i] for i, c in enumerate(corner)], axis=0)
        out = out + weight * x[at]
    return np.where(inside, out, 0.0)


def resize(size: Sequence[int], linear: bool = True) -> Kernel:
    """Resampled to ``size`` with cell centres aligned."""

    def run(x):
        axes = [(np.arange(m) + 0.5) * n / m - 0.5 for n, m in zip(x.shape, size, strict=True)]
        if not linear:
            axes = [np.floor((np.arange(m)) * n / m) for n, m in zip(x.shape, size, strict=True)]
        return _sample(x, np.stack(np.meshgrid(*axes, indexing="ij")), linear, "border")

    return run


def zoom(factor: float | Sequence[float], linear: bool = True) -> Kernel:
    """Scaled in place of resized: the array keeps its shape, cropped or padded about the centre."""

    def run(x):
        factors = [factor] * x.ndim if isinstance(factor, int | float) else factor
        big = resize([max(int(n * f), 1) for n, f in zip(x.shape, factors, strict=True)], linear)(x)
        return center_crop(x.shape)(spatial_pad(x.shape, "edge")(big))

    return run


def spacing(current: Sequence[float], target: Sequence[float], linear: bool = True) -> Kernel:
    """From one voxel size to another, the first voxel's centre staying where it is; beyond the last
    centre its value holds.  A side of n voxels gets round((n - 1) * current / target + 1)."""

    def run(x):
        steps = [t / c for c, t in zip(current, target, strict=True)]
        axes = [np.arange(int(np.round((n - 1) / step + 1))) * step for n, step in zip(x.shape, steps, strict=True)]
        return _sample(x, np.stack(np.meshgrid(*axes, indexing="ij")), linear, "border")

    return run


#: The letters of both ends of the world axes.
ENDS = (("L", "R"), ("P", "A"), ("I", "S"))


def _axes_of(affine) -> list[tuple[int, bool]]:
    """For each array axis, the world axis that it follows most closely and whether it rises along it."""
    linear = np.asarray(affine, float)[:-1, :-1]
    u, _, v = np.linalg.svd(linear / np.linalg.norm(linear, axis=0))
    turned, found = u @ v, {}
    for flat in np.argsort(-np.abs(turned), axis=None, kind="stable"):
        world, axis = np.unravel_index(flat, turned.shape)
        if axis not in found and world not in [w for w, _ in found.values()]:
            found[int(axis)] = (int(world), bool(turned[world, axis] > 0))
    return [found[a] for a in range(len(found))]


def axis_codes(affine) -> str:
    """The letters that the array axes of an affine point to, such as ``RAS``."""
    return "".join(ENDS[world][rises] for world, rises in _axes_of(affine))


def _turns(affine, codes: str) -> list[tuple[int, bool]]:
    """For each axis of the result, the array axis that it takes and whether it's flipped."""
    have = {world: (axis, rises) for axis, (world, rises) in enumerate(_axes_of(affine))}
    wanted = [(w, c == ends[1]) for c in codes for w, ends in enumerate(ENDS) if c in ends]
    if len(wanted) != len(codes) or sorted(w for w, _ in wanted) != sorted(have):
        raise ValueError(f"{codes!r} doesn't name each of {len(have)} axes once")
    return [(have[w][0], have[w][1] != rises) for w, rises in wanted]


def reorient(affine, codes: str) -> Kernel:
    """Axes permuted and flipped so that they point to ``codes``; no value changes."""
    turns = _turns(affine, codes)

    def run(x):
        moved = np.transpose(x, [axis for axis, _ in turns])
        return np.flip(moved, [i for i, (_, flipped) in enumerate(turns) if flipped])

    return run


def reoriented_affine(affine, shape: Sequence[int], codes: str) -> np.ndarray:
    """The affine that belongs to what ``reorient`` makes of an array of ``shape``."""
    turns, n = _turns(affine, codes), len(shape)
    back = np.zeros((n + 1, n + 1))
    back[n, n] = 1.0
    for i, (axis, flipped) in enumerate(turns):
        back[axis, i], back[axis, n] = (-1.0, shape[axis] - 1.0) if flipped else (1.0, 0.0)
    return np.asarray(affine, float) @ back


def affine(matrix: Sequence[Sequence[float]], linear: bool = True, padding: str = "zeros") -> Kernel:
    """Output places mapped to input places by a homogeneous matrix about the array's centre."""

    def run(x):
        m = np.asarray(matrix, float)
        middle = (np.array(x.shape) - 1) / 2
        grid = np.stack(np.meshgrid(*[np.arange(n) for n in x.shape], indexing="ij")).reshape(x.ndim, -1) - middle[:, None]
        points = m[: x.ndim, : x.ndim] @ grid + m[: x.ndim, x.ndim :] + middle[:, None]
        return _sample(x, points.reshape(x.ndim, *x.shape), linear, padding)

    return run


def rotation(angle: float) -> list[list[float]]:
    c, s = float(np.cos(angle)), float(np.sin(angle))
    return [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]]


# --- filters ---


def _along(x: np.ndarray, kernel: np.ndarray, axis: int, mode: str = "edge") -> np.ndarray:
    r = len(kernel) // 2
    width = [(0, 0)] * x.ndim
    width[axis] = (r, r)
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(x, width, mode), len(kernel), axis)
    return wide @ kernel[::-1]


def gaussian_smooth(sigma: float, truncated: float = 4.0) -> Kernel:
    """Separable smoothing by a sampled Gaussian of sum one; the border is repeated."""
    r = max(int(truncated * sigma + 0.5), 1)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()

    def run(x):
        for axis in range(x.ndim):
            x = _along(x, k, axis)
        return x

    return run


def gaussian_sharpen(sigma1: float, sigma2: float, alpha: float) -> Kernel:
    def run(x):
        soft = gaussian_smooth(sigma1)(x)
        return soft + alpha * (soft - gaussian_smooth(sigma2)(soft))

    return run


def median_filter(radius: int) -> Kernel:
    """Median of the cube around each place; the border is repeated."""

    def run(x):
        view = np.lib.stride_tricks.sliding_window_view(np.pad(x, radius, "edge"), (2 * radius + 1,) * x.ndim)
        return np.median(view.reshape(*x.shape, -1), axis=-1)

    return run


def savitzky_golay(window: int, order: int, axis: int = -1) -> Kernel:
    """Least-squares polynomial smoothing along an axis, zeros beyond the border."""
    at = np.arange(-(window // 2), window // 2 + 1)
    k = np.linalg.pinv(np.vander(at, order + 1, increasing=True))[0]
    return lambda x: _along(x, k, axis % x.ndim, "constant")


def sobel(axis: int) -> Kernel:
    def run(x):
        for i in range(x.ndim):
            x = _along(x, np.array([1.0, 0.0, -1.0]) / 2 if i == axis else np.array([1.0, 2.0, 1.0]) / 4, i)
        return x

    return run


def gibbs_noise(alpha: float) -> Kernel:
    """Keeps frequencies within a ball that shrinks as ``alpha`` goes from 0 to 1."""

    def run(x):
        k = np.fft.fftshift(np.fft.fftn(x))
        middle = [n // 2 for n in x.shape]
        far = np.sqrt(sum((g - c) ** 2 for g, c in zip(np.meshgrid(*map(np.arange, x.shape), indexing="ij"), middle, strict=True)))
        limit = (1 - alpha) * far.max()
        return np.real(np.fft.ifftn(np.fft.ifftshift(np.where(far <= limit, k, 0))))

    return run


def spike(place: Sequence[int], log_value: float) -> Kernel:
    """One frequency's log magnitude replaced, its phase kept."""

    def run(x):
        k = np.fft.fftshift(np.fft.fftn(x))
        k[tuple(place)] = np.exp(log_value) * np.exp(1j * np.angle(k[tuple(place)]))
        return np.real(np.fft.ifftn(np.fft.ifftshift(k)))

    return run


# --- labels ---


def _offsets(ndim: int, full: bool) -> list[tuple[int, ...]]:
    return [o for o in product((-1, 0, 1), repeat=ndim) if any(o) and (full or sum(map(abs, o)) == 1)]


def components(mask: np.ndarray, full: bool = False) -> np.ndarray:
    """Connected components of a mask, numbered from 1 by their first place."""
    number = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = _offsets(mask.ndim, full)
    while True:
        new, padded = number, np.pad(number, 1)
        for o in steps:
            side = padded[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, mask.shape, strict=True))]
            new = np.where((side > 0) & (number > 0), np.where(new < side, new, side), new)
        flat = np.append(0, new.ravel())
        new = flat[new]  # a pointer jump: the number of a place is the place of its number
        if (new == number).all():
            break
        number = new
    kept = np.unique(number[number > 0])
    return np.where(number > 0, np.searchsorted(kept, number) + 1, 0)


def keep_largest(count: int = 1, full: bool = False) -> Kernel:
    """Zeroes all but the largest components of what is above zero; the earlier of equal ones stays."""

    def run(x):
        found = components(x > 0, full)
        sizes = np.bincount(found.ravel())[1:]
        best = np.argsort(-sizes, kind="stable")[:count] + 1
        return np.where(np.isin(found, best), x, 0)

    return run


def remove_small(least: int, full: bool = False) -> Kernel:
    def run(x):
        found = components(x > 0, full)
        sizes = np.bincount(found.ravel())
        return np.where(sizes[found] >= least, x, 0)

    return run


def fill_holes(label: float = 1.0) -> Kernel:
    """Background that doesn't reach the border becomes ``label``."""

    def run(x):
        empty = components(np.pad(x == 0, 1, constant_values=True))
        inner = empty[tuple(slice(1, -1) for _ in x.shape)]
        return np.where((x == 0) & (inner != empty.flat[0]), label, x)

    return run


def _morph(x: np.ndarray, size: int, pick: Callable, outside: float) -> np.ndarray:
    r = size // 2
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, r, constant_values=outside), (size,) * x.ndim)
    return pick(view.reshape(*x.shape, -1), axis=-1)


def dilate(size: int = 3) -> Kernel:
    return lambda x: _morph(x, size, np.max, -np.inf)


def erode(size: int = 3) -> Kernel:
    return lambda x: _morph(x, size, np.min, np.inf)


def contour() -> Kernel:
    """Foreground that touches background, across the border too."""
    return lambda x: np.where((x > 0) & (_morph((x > 0).astype(float), 3, np.min, 0.0) == 0), x, 0)


def edge_places(mask: np.ndarray) -> np.ndarray:
    """Mask places with a face neighbour outside the mask."""
    wide = np.pad(mask, 1)
    inner = np.ones_like(mask)
    for o in _offsets(mask.ndim, False):
        inner &= wide[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, mask.shape, strict=True))]
    return np.argwhere(mask & ~inner)


def distances_to(points: np.ndarray, targets: np.ndarray, spacing: Sequence[float] | None = None) -> np.ndarray:
    """Distance of each point to the nearest target, in blocks of bounded memory."""
    scale = np.asarray(spacing if spacing is not None else [1.0] * points.shape[1])
    p, t, out = points * scale, targets * scale, []
    for a in range(0, len(p), 1024):
        best = np.full(len(p[a : a + 1024]), np.inf)
        for b in range(0, len(t), 4096):
            best = np.minimum(best, ((p[a : a + 1024, None] - t[None, b : b + 4096]) ** 2).sum(-1).min(1))
        out.append(np.sqrt(best))
    return np.concatenate(out) if out else np.zeros(0)


def distance_transform() -> Kernel:
    """Distance of each foreground place to the nearest background; an axis at a time, exactly."""

    def run(x):
        d = np.where(x > 0, np.inf, 0.0)
        for axis in range(x.ndim):
            n = x.shape[axis]
            gap = (np.arange(n)[:, None] - np.arange(n)) ** 2.0
            d = np.moveaxis((np.moveaxis(d, axis, -1)[..., None, :] + gap).min(-1), -1, axis)
        return np.sqrt(d)

    return run


# --- pair metrics ---


def hausdorff(percentile: float | None = None, directed: bool = False) -> Callable[[np.ndarray, np.ndarray], float]:
    """Greatest (or a percentile's) surface distance; NaN if either mask is empty."""

    def run(pred, truth):
        a, b = edge_places(pred > 0), edge_places(truth > 0)
        if not len(a) or not len(b):
            return np.nan
        reduce = np.max if percentile is None else lambda d: np.percentile(d, percentile)
        there = reduce(distances_to(a, b))
        return there if directed else max(there, reduce(distances_to(b, a)))

    return run


def surface_distance(symmetric: bool = False) -> Callable[[np.ndarray, np.ndarray], float]:
    """Mean distance of the prediction's surface to the truth's; of both if symmetric."""

    def run(pred, truth):
        a, b = edge_places(pred > 0), edge_places(truth > 0)
        if not len(a) or not len(b):
            return np.nan
        d = distances_to(a, b)
        return float(np.mean(np.concatenate([d, distances_to(b, a)]) if symmetric else d))

    return run


def surface_dice(limit: float) -> Callable[[np.ndarray, np.ndarray], float]:
    """Share of both surfaces that lies within ``limit`` of the other."""

    def run(pred, truth):
        a, b = edge_places(pred > 0), edge_places(truth > 0)
        if not len(a) and not len(b):
            return np.nan
        if not len(a) or not len(b):
            return 0.0
        near = (distances_to(a, b) <= limit).sum() + (distances_to(b, a) <= limit).sum()
        return near / (len(a) + len(b))

    return run


def ssim(peak: float = 1.0, window: int = 7, k1: float = 0.01, k2: float = 0.03) -> Callable[[np.ndarray, np.ndarray], float]:
    """Mean structural similarity over all whole windows; an axis shorter than the window is one window."""

    def run(a, b):
        def mean(x):
            view = np.lib.stride_tricks.sliding_window_view(x, tuple(min(window, n) for n in x.shape))
            return view.mean(tuple(range(-x.ndim, 0)))

        c1, c2 = (k1 * peak) ** 2, (k2 * peak) ** 2
        ma, mb = mean(a), mean(b)
        va, vb, cov = mean(a * a) - ma * ma, mean(b * b) - mb * mb, mean(a * b) - ma * mb
        return float(((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())

    return run
