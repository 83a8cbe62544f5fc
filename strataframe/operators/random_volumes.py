"""Random array operators: a kernel that also takes a generator seeded by the row.

The generator depends on the seed, the operator's name and the row's identity alone, so a row gets
the same draw on every run, in every partitioning and after a lost executor."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataframe.operators import volumes as V

RandomKernel = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def generator(seed: int, name: str, *identity) -> np.random.Generator:
    text = ":".join(map(str, (seed, name, *identity)))
    return np.random.default_rng(int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little"))


def apply_random(df: DataFrame, kernel: RandomKernel, identity: Sequence[str], seed: int = 0, prob: float = 1.0, name: str = "", shape: str = "shape", values: str = "values") -> DataFrame:
    """``df`` with each row's array replaced by the kernel's with chance ``prob``."""
    names = df.columns

    def run(batches):
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in identity), strict=True))
            shapes, flats = [], []
            for key, s, v in zip(ids, batch.column(shape).to_pylist(), batch.column(values).to_pylist(), strict=True):
                if s is None or v is None:
                    shapes.append(s)
                    flats.append(v)
                    continue
                x, rng = np.asarray(v, float).reshape(s), generator(seed, name, *key)
                out = kernel(x, rng) if rng.random() < prob else x
                shapes.append(list(out.shape))
                flats.append(out.astype(float).ravel())
            made = {shape: pa.array(shapes, pa.list_(pa.int32())), values: pa.array(flats, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in names], names=names)

    return df.mapInArrow(run, df.schema)


def apply_random_keys(df: DataFrame, kernel: RandomKernel | dict[str, RandomKernel], keys: Sequence[str], identity: Sequence[str], seed: int = 0, prob: float = 1.0, name: str = "", allow_missing: bool = False) -> DataFrame:
    """``df`` with the arrays of all ``keys`` changed together, with chance ``prob`` a row.

    Each key's kernel starts from the row's own draw anew, so an image and its labels are turned,
    cropped or warped alike.  Keys are as in ``volumes.apply_keys``; null arrays stay null."""
    found, names = V.known_keys(df, keys, allow_missing), df.columns
    chosen = {k: kernel[k] if isinstance(kernel, dict) else kernel for k in found}

    def run(batches):
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in identity), strict=True))
            go = [generator(seed, f"{name}:chance", *row).random() < prob for row in ids]
            made = {}
            for k, f in chosen.items():
                arrays = zip(ids, go, V.struct_arrays(batch.column(k)), strict=True)
                made[k] = V.array_structs([f(x, generator(seed, name, *row)) if yes and x is not None else x for row, yes, x in arrays])
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in names], names=names)

    return df.mapInArrow(run, df.schema) if chosen else df


def chosen(kernels: Sequence[RandomKernel], weights: Sequence[float] | None = None) -> RandomKernel:
    """One of several kernels for each row, by weight."""
    p = np.asarray(weights or [1.0] * len(kernels), float)
    return lambda x, rng: kernels[int(rng.choice(len(kernels), p=p / p.sum()))](x, rng)


# --- noise and intensity ---


def gaussian_noise(mean: float = 0.0, std: float = 0.1) -> RandomKernel:
    return lambda x, rng: x + rng.normal(mean, rng.uniform(0, std), x.shape)


def rician_noise(mean: float = 0.0, std: float = 0.1) -> RandomKernel:
    return lambda x, rng: np.sqrt((x + rng.normal(mean, std, x.shape)) ** 2 + rng.normal(mean, std, x.shape) ** 2)


def shift_intensity(low: float, high: float) -> RandomKernel:
    return lambda x, rng: x + rng.uniform(low, high)


def std_shift(low: float, high: float, nonzero: bool = False) -> RandomKernel:
    def run(x, rng):
        used = x != 0 if nonzero else np.ones(x.shape, bool)
        return np.where(used, x + rng.uniform(low, high) * (x[used].std() if used.any() else 0.0), x)

    return run


def scale_intensity(low: float, high: float) -> RandomKernel:
    return lambda x, rng: x * (1 + rng.uniform(low, high))


def scale_fixed_mean(low: float, high: float) -> RandomKernel:
    return lambda x, rng: (x - x.mean()) * (1 + rng.uniform(low, high)) + x.mean()


def contrast(low: float, high: float) -> RandomKernel:
    def run(x, rng):
        span = x.max() - x.min()
        return ((x - x.min()) / (span + 1e-7)) ** rng.uniform(low, high) * span + x.min()

    return run


def bias_field(degree: int = 3, strength: float = 0.1) -> RandomKernel:
    """Times exp of a polynomial with random coefficients over [-1, 1] axes."""

    def run(x, rng):
        axes = np.meshgrid(*[np.linspace(-1, 1, n) for n in x.shape], indexing="ij")
        field = np.zeros(x.shape)
        for powers in np.ndindex(*[degree + 1] * x.ndim):
            if 0 < sum(powers) <= degree:
                term = rng.uniform(0, strength) * np.ones(x.shape)
                for a, p in zip(axes, powers, strict=True):
                    term = term * a**p
                field += term
        return x * np.exp(field)

    return run


def histogram_shift(points: int = 10, strength: float = 0.5) -> RandomKernel:
    """Values through a monotone broken line between random control points; constants stay."""

    def run(x, rng):
        low, high = x.min(), x.max()
        if low == high:
            return x
        at = np.linspace(0, 1, points)
        to = np.sort(np.clip(at + np.append(0, np.append(rng.uniform(-strength, strength, points - 2) / points, 0)), 0, 1))
        return np.interp(x, low + at * (high - low), low + to * (high - low))

    return run


def gaussian_smooth(low: float, high: float) -> RandomKernel:
    return lambda x, rng: V.gaussian_smooth(rng.uniform(low, high))(x)


def gaussian_sharpen(alpha: tuple[float, float] = (10.0, 30.0)) -> RandomKernel:
    return lambda x, rng: V.gaussian_sharpen(rng.uniform(0.5, 1.0), 0.5, rng.uniform(*alpha))(x)


def gibbs_noise(low: float, high: float) -> RandomKernel:
    return lambda x, rng: V.gibbs_noise(rng.uniform(low, high))(x)


def low_resolution(low: float, high: float) -> RandomKernel:
    def run(x, rng):
        f = rng.uniform(low, high)
        return V.resize(x.shape)(V.resize([max(1, int(n * f)) for n in x.shape], False)(x))

    return run


# --- holes and crops ---


def _boxes(shape, rng, count, size):
    for _ in range(count):
        start = [int(rng.integers(0, max(n - s, 0) + 1)) for n, s in zip(shape, size, strict=True)]
        yield tuple(slice(a, a + s) for a, s in zip(start, size, strict=True))


def coarse_dropout(holes: int, size: Sequence[int], fill: float = 0.0, inside: bool = True) -> RandomKernel:
    def run(x, rng):
        mask = np.zeros(x.shape, bool)
        for box in _boxes(x.shape, rng, holes, size):
            mask[box] = True
        return np.where(mask == inside, fill, x)

    return run


def coarse_shuffle(holes: int, size: Sequence[int]) -> RandomKernel:
    def run(x, rng):
        out = x.copy()
        for box in _boxes(x.shape, rng, holes, size):
            out[box] = rng.permutation(out[box].ravel()).reshape(out[box].shape)
        return out

    return run


def spatial_crop(size: Sequence[int], random_size: bool = False) -> RandomKernel:
    def run(x, rng):
        real = [min(n, int(rng.integers(s, n + 1)) if random_size and s < n else s) for n, s in zip(x.shape, size, strict=True)]
        return x[next(_boxes(x.shape, rng, 1, real))]

    return run


# --- geometry ---


def flip(axes: Sequence[int] | None = None) -> RandomKernel:
    """Flips the given axes, or else one axis at random."""
    return lambda x, rng: np.flip(x, axes if axes is not None else int(rng.integers(x.ndim)))


def rotate90(most: int = 3, axes: tuple[int, int] = (0, 1)) -> RandomKernel:
    return lambda x, rng: np.rot90(x, int(rng.integers(1, most + 1)), axes)


def rotate(angle: float) -> RandomKernel:
    return lambda x, rng: V.affine(V.rotation(rng.uniform(-angle, angle)), padding="border")(x)


def zoom(low: float, high: float) -> RandomKernel:
    return lambda x, rng: V.zoom(rng.uniform(low, high))(x)


def affine(rotation: float = 0.0, shear: float = 0.0, translate: float = 0.0, scale: float = 0.0) -> RandomKernel:
    """A random affine map of two axes."""

    def run(x, rng):
        u = lambda r, n=1: rng.uniform(-r, r, n)
        m = np.array(V.rotation(u(rotation)[0]))
        s = np.eye(3)
        s[0, 1], s[1, 0] = u(shear, 2)
        z = np.diag([*(1 + u(scale, 2)), 1.0])
        t = np.eye(3)
        t[:2, 2] = u(translate, 2)
        return V.affine(m @ s @ t @ z)(x)

    return run


def _warped(x, shift):
    grid = np.stack(np.meshgrid(*map(np.arange, x.shape), indexing="ij")).astype(float)
    return V._sample(x, grid + shift, True, "border")


def elastic(sigma: float, magnitude: float) -> RandomKernel:
    """Places moved by smoothed noise."""
    return lambda x, rng: _warped(x, np.stack([V.gaussian_smooth(sigma)(rng.uniform(-1, 1, x.shape)) for _ in range(x.ndim)]) * magnitude)


def smooth_deform(cells: int, strength: float) -> RandomKernel:
    """Places moved by a field of few random values, interpolated."""
    return lambda x, rng: _warped(x, np.stack([V.resize(x.shape)(rng.uniform(-strength, strength, [cells] * x.ndim)) for _ in range(x.ndim)]))


def grid_distortion(cells: int, limit: float) -> RandomKernel:
    """Cells of a grid stretched at random along each axis."""

    def run(x, rng):
        shift = []
        for i, n in enumerate(x.shape):
            widths = 1 + rng.uniform(-limit, limit, cells)
            ends = np.append(0, np.cumsum(widths)) / widths.sum() * (n - 1)
            line = np.interp(np.arange(n), np.linspace(0, n - 1, cells + 1), ends) - np.arange(n)
            shift.append(line.reshape([-1 if j == i else 1 for j in range(x.ndim)]) * np.ones(x.shape))
        return _warped(x, np.stack(shift))

    return run


def smooth_intensity(cells: int, low: float, high: float) -> RandomKernel:
    return lambda x, rng: x * V.resize(x.shape)(rng.uniform(low, high, [cells] * x.ndim))


def smooth_contrast(cells: int, low: float, high: float) -> RandomKernel:
    def run(x, rng):
        span = max(x.max() - x.min(), 1e-7)
        return ((x - x.min()) / span) ** V.resize(x.shape)(rng.uniform(low, high, [cells] * x.ndim)) * span + x.min()

    return run


# --- signals: the last axis is time ---


def signal_shift(most: float = 0.5, fill: float | None = None) -> RandomKernel:
    """Shifted by a share of its length, around the end or with a fill."""

    def run(x, rng):
        k = round(rng.uniform(-most, most) * x.shape[-1])
        out = np.roll(x, k, -1)
        if fill is not None and k:
            out[..., slice(0, k) if k > 0 else slice(k, None)] = fill
        return out

    return run


def signal_drop(low: float = 0.0, high: float = 0.3) -> RandomKernel:
    def run(x, rng):
        n = int(rng.uniform(low, high) * x.shape[-1])
        out, a = x.copy(), int(rng.integers(0, x.shape[-1] - n + 1))
        out[..., a : a + n] = 0
        return out

    return run


def _segment(x, rng, partial):
    n = x.shape[-1]
    if not partial:
        return np.ones(n)
    a, b = sorted(rng.integers(0, n + 1, 2))
    return ((np.arange(n) >= a) & (np.arange(n) < b)).astype(float)


def add_sine(magnitude: tuple[float, float], frequency: tuple[float, float], partial: bool = False) -> RandomKernel:
    def run(x, rng):
        t = np.arange(x.shape[-1]) / x.shape[-1]
        return x + rng.uniform(*magnitude) * np.sin(2 * np.pi * rng.uniform(*frequency) * t) * _segment(x, rng, partial)

    return run


def add_square_pulse(magnitude: tuple[float, float], frequency: tuple[float, float], partial: bool = False) -> RandomKernel:
    def run(x, rng):
        t = np.arange(x.shape[-1]) / x.shape[-1]
        wave = np.where((t * rng.uniform(*frequency)) % 1 < 0.5, 1.0, -1.0)
        return x + rng.uniform(*magnitude) * wave * _segment(x, rng, partial)

    return run


def fill_empty(value: float = 0.0) -> V.Kernel:
    return lambda x: np.where(np.isnan(x), value, x)


def remove_frequency(frequency: float, rate: float, quality: float) -> V.Kernel:
    """A notch at one frequency: its band of ``frequency / quality`` goes."""

    def run(x):
        f = np.fft.rfftfreq(x.shape[-1], 1 / rate)
        gone = np.abs(f - frequency) <= frequency / quality / 2
        return np.fft.irfft(np.where(gone, 0, np.fft.rfft(x)), x.shape[-1])

    return run


def envelope() -> V.Kernel:
    """Magnitude of the analytic signal along the last axis."""

    def run(x):
        n = x.shape[-1]
        gain = np.zeros(n)
        gain[0] = 1
        gain[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            gain[n // 2] = 1
        return np.abs(np.fft.ifft(np.fft.fft(x) * gain))

    return run


def wavelet(scales: Sequence[float]) -> V.Kernel:
    """Correlation with second derivatives of Gaussians, one row for each scale."""

    def run(x):
        rows = []
        for s in scales:
            t = np.arange(-int(5 * s), int(5 * s) + 1) / s
            k = (1 - t * t) * np.exp(-t * t / 2) * 2 / (np.sqrt(3 * s) * np.pi**0.25)
            rows.append(V._along(x, k, x.ndim - 1, "constant"))
        return np.stack(rows)

    return run
