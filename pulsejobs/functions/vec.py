"""Numpy kernels on Arrow batches of equal-length windows: linear maps, spectra, splines, multi-scale maxima, alignment.

Each is an Arrow UDF; Spark does the partitioning. Rows of a slice of a batch
are stacked by length, so a kernel runs once for each length and slice. Null
arrays give null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Types as objects: a worker that imports this module has no session to parse names.
DOUBLES = T.ArrayType(T.DoubleType())


#: Rows of an Arrow batch that a kernel has as Python objects at a time. A batch itself may have ten thousand.
SLICE = 256


def in_slices(f: Callable[..., pd.Series], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f over slices of the columns of a batch; only one slice at a time is more than Arrow memory."""
    out = []
    for start in range(0, len(columns[0]), SLICE):
        made = f(*[c.slice(start, SLICE).to_pandas() for c in columns])
        out.append(pa.Array.from_pandas(made, mask=made.isnull().to_numpy(), type=kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)


def kernel_udf(kind: T.DataType) -> Callable:
    """An Arrow UDF of a function on pandas Series that the optimizer leaves where it stands: moved into a lambda of another column it could not run.

    The function sees a batch in slices, so what a worker holds does not grow
    with the rows of a batch times the size of what a kernel makes of a row.
    """
    arrow_kind = to_arrow_type(kind)

    def make(f: Callable[..., pd.Series]) -> Callable:
        def apply(*columns: pa.Array) -> pa.Array:
            return in_slices(f, arrow_kind, *columns)

        return F.arrow_udf(apply, kind).asNondeterministic()

    return make


def by_length(rows: pd.Series, kernel: Callable[[np.ndarray, np.ndarray], list]) -> pd.Series:
    """kernel(stacked, row numbers) for the rows of each length."""
    out: list = [None] * len(rows)
    lengths = rows.map(lambda r: -1 if r is None else len(r)).to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        for i, r in zip(at, kernel(np.stack([np.asarray(rows.iloc[i], float) for i in at]), at), strict=True):
            out[i] = r
    return pd.Series(out)


def linear_map(m: np.ndarray):
    """Each row times a fixed matrix (out, in); rows of another length give null."""

    @kernel_udf(DOUBLES)
    def apply(a: pd.Series) -> pd.Series:
        return by_length(a, lambda x, _: list(x @ m.T) if x.shape[1] == m.shape[1] else [None] * len(x))

    return apply


def lag_sums(a: np.ndarray, p: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """sum of a[l] * p[l + d] for d = len(p) - 1 - k and each k in [lo, hi), by Fourier transforms."""
    size = 1 << (len(a) + len(p)).bit_length()
    every = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(p, size), size)
    return every[(len(p) - 1 - np.arange(lo, hi)) % size]


def lag_sum(a: np.ndarray, p: np.ndarray, d: int) -> float:
    """The same sum for one d, directly."""
    a, p = a[max(-d, 0) :], p[max(d, 0) :]
    n = min(len(a), len(p))
    return np.dot(a[:n], p[:n])


def align_shift(fs: int):
    """Index k, in [n - fs, n) of the full correlation, with the largest sum of abp[l] * ppg[l + N - 1 - k]; the first of equals.

    Fourier sums find the lags near the largest; those are summed directly, so that rounding settles no tie.
    """

    @kernel_udf(T.IntegerType())
    def best(abp: pd.Series, ppg: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, p, m in zip(abp, ppg, n, strict=True):
            a, p, lo = np.asarray(a, float), np.asarray(p, float), int(m) - fs
            near = lag_sums(a, p, lo, int(m))
            room = 1e-9 * np.linalg.norm(a) * np.linalg.norm(p)
            ks = lo + (np.flatnonzero(near >= near.max() - room) if np.isfinite(near).all() else np.arange(fs))
            out.append(int(ks[int(np.argmax([lag_sum(a, p, len(p) - 1 - k) for k in ks]))]))
        return pd.Series(out)

    return best


def block_lag_sums(fs: int, block: int):
    """Product sums of a block of abp samples with ppg samples ``base + r`` later, r = 0 .. fs - 1, and both sums of squares; samples come as places in the block and values."""

    def placed(at, values, size: int) -> np.ndarray:
        x = np.zeros(size)
        if at is not None and len(at):
            x[np.asarray(at, int)] = np.asarray(values, float)
        return x

    @kernel_udf(DOUBLES)
    def sums(ai: pd.Series, ax: pd.Series, pi: pd.Series, px: pd.Series, base: pd.Series) -> pd.Series:
        out = []
        for i, x, j, y, b in zip(ai, ax, pi, px, base, strict=True):
            a, p = placed(i, x, block), placed(j, y, block + 2 * fs)
            later = np.lib.stride_tricks.sliding_window_view(p, block)[int(b) : int(b) + fs]
            out.append(np.concatenate([later @ a, [a @ a, p @ p]]))
        return pd.Series(out)

    return sums


def ampd(x: np.ndarray, scale: int) -> list[np.ndarray]:
    """Multi-scale maxima of stacked rows: after linear detrending, samples larger than both k-neighbours for every k below the best scale.

    A neighbour beyond the end does not count against a sample. The best scale
    has the most maxima, weighted by n // 2 - k + 1; of equals the smallest.
    """
    rows, n = x.shape
    t = np.arange(n) - (n - 1) / 2
    # summed along each row, so that a row gives the same alone and in a stack
    slope = ((x * t).sum(axis=1, keepdims=True) / (t @ t)) if n > 1 else 0.0
    y = x - x.mean(axis=1, keepdims=True) - slope * t if n > 1 else x
    top = min(scale, n // 2)
    if top < 1:
        return [np.zeros(0, np.int64)] * rows
    counts = np.zeros((rows, top))
    every = np.ones((top, rows, n), bool)
    for k in range(1, top + 1):
        big = np.ones((rows, n), bool)
        big[:, k:] &= y[:, k:] > y[:, :-k]
        big[:, :-k] &= y[:, :-k] > y[:, k:]
        every[k - 1] = big
        counts[:, k - 1] = big.sum(axis=1) * (n // 2 - k + 1)
    best = counts.argmax(axis=1)
    held = np.logical_and.accumulate(every, axis=0)
    return [np.flatnonzero(held[b, r]) for r, b in enumerate(best)]


def multi_scale_maxima(scale: int, sign: int = 1):
    @kernel_udf(T.ArrayType(T.IntegerType()))
    def find(a: pd.Series) -> pd.Series:
        return by_length(a, lambda x, _: ampd(sign * x, scale))

    return find


@lru_cache(32)
def band_pass_matrix(n: int, low: float, high: float, fs: float) -> np.ndarray:
    """(n, n): first-order Butterworth band-pass, forward and backward, as a linear map.

    Bilinear transform with pre-warped edges. The rows are extended by 9 samples
    at both ends, point-reflected; each direction starts in the steady state of
    its first sample.
    """
    k = 2 * fs
    w1, w2 = (k * np.tan(np.pi * f / fs) for f in (low, high))
    bw, w0 = w2 - w1, w1 * w2
    den = k * k + bw * k + w0
    b = np.array([bw * k, 0.0, -bw * k]) / den
    a = np.array([1.0, 2 * (w0 - k * k) / den, (k * k - bw * k + w0) / den])
    pad = min(9, n - 1)
    eye = np.eye(n)
    x = np.concatenate([2 * eye[:1] - eye[pad:0:-1], eye, 2 * eye[-1:] - eye[-2 : -pad - 2 : -1]])
    # state of the transposed second-order form under a constant input of 1; its output is then 0
    gain = b.sum() / a.sum()
    z2 = b[2] - a[2] * gain
    z1 = z2 + b[1] - a[1] * gain

    def once(x: np.ndarray) -> np.ndarray:
        s1, s2, y = z1 * x[0], z2 * x[0], np.empty_like(x)
        for i in range(len(x)):
            y[i] = b[0] * x[i] + s1
            s1 = b[1] * x[i] - a[1] * y[i] + s2
            s2 = b[2] * x[i] - a[2] * y[i]
        return y

    y = once(once(x)[::-1])[::-1]
    return y[pad : pad + n]


def band_pass(low: float, high: float, fs: float):
    """Windows of any length without their mean, band-passed without phase shift, scaled to [0, 1]; one matrix for each length."""

    def kernel(x: np.ndarray, _) -> list:
        y = (x - x.mean(axis=1, keepdims=True)) @ band_pass_matrix(x.shape[1], low, high, fs).T
        lo, hi = y.min(axis=1, keepdims=True), y.max(axis=1, keepdims=True)
        return list((y - lo) / (hi - lo + 1e-10))

    @kernel_udf(DOUBLES)
    def apply(a: pd.Series) -> pd.Series:
        return by_length(a, kernel)

    return apply


def bends(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of stacked not-a-knot splines, from the gaps ``h`` and slopes ``s`` between the knots, four knots or more.

    The third derivative does not change at the second knot and at the last but
    one; with that the outer bends go out of their neighbours' equations. What
    is left has three diagonals and a dominant middle one, and is solved by
    elimination along the knots, for all rows at once.
    """
    low, mid, high, right = h[:, :-1].copy(), 2 * (h[:, :-1] + h[:, 1:]), h[:, 1:].copy(), 6 * np.diff(s, axis=1)
    h0, h1, g1, g0 = h[:, 0], h[:, 1], h[:, -2], h[:, -1]
    mid[:, 0] += h0 * (h0 + h1) / h1
    high[:, 0] -= h0 * h0 / h1
    mid[:, -1] += g0 * (g0 + g1) / g1
    low[:, -1] -= g0 * g0 / g1
    n = mid.shape[1]
    for i in range(1, n):
        f = low[:, i] / mid[:, i - 1]
        mid[:, i] -= f * high[:, i - 1]
        right[:, i] -= f * right[:, i - 1]
    d = np.empty((len(h), n + 2))
    d[:, n] = right[:, -1] / mid[:, -1]
    for i in range(n - 2, -1, -1):
        d[:, i + 1] = (right[:, i] - high[:, i] * d[:, i + 2]) / mid[:, i]
    d[:, 0] = ((h0 + h1) * d[:, 1] - h0 * d[:, 2]) / h1
    d[:, -1] = ((g0 + g1) * d[:, -2] - g0 * d[:, -3]) / g1
    return d


def splines(x: np.ndarray, y: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(rows, places): not-a-knot cubic splines through stacked knots (rows, n), at rising places; a parabola for three knots, a line for two."""
    (rows, n), m = x.shape, len(places)
    h = np.diff(x, axis=1)
    s = np.diff(y, axis=1) / h
    if n > 3:
        d = bends(h, s)
    else:  # one bend for all, or none
        d = np.repeat(2 * np.diff(s, axis=1) / (h[:, :1] + h[:, 1:]) if n == 3 else np.zeros((rows, 1)), n, axis=1)
    # the stretch of each place, by the number of knots at or before it
    first = np.searchsorted(places, x)
    counts = np.bincount((np.arange(rows)[:, None] * (m + 1) + first).ravel(), minlength=rows * (m + 1)).reshape(rows, m + 1)
    k = np.clip(np.cumsum(counts[:, :m], axis=1) - 1, 0, n - 2)
    of = lambda v, j: np.take_along_axis(v, j, axis=1)
    gap = of(h, k)
    left, right = places - of(x, k), of(x, k + 1) - places
    a, b = of(d, k), of(d, k + 1)
    return (a * right**3 + b * left**3) / (6 * gap) + (of(y, k) / gap - a * gap / 6) * right + (of(y, k + 1) / gap - b * gap / 6) * left


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One spline, at any places."""
    order = np.argsort(at, kind="stable")
    out = np.empty(len(at))
    out[order] = splines(np.asarray(x, float)[None], np.asarray(y, float)[None], np.asarray(at, float)[order])[0]
    return out


@kernel_udf(DOUBLES)
def spline_baseline(knots: pd.Series, values: pd.Series, n: pd.Series) -> pd.Series:
    """The spline through (knots, values) at 0..n-1; null for fewer than two knots. Rows of a batch with as many knots and places are solved together."""
    out: list = [None] * len(knots)
    stacks: dict[tuple[int, int], list[int]] = {}
    for i, (k, m) in enumerate(zip(knots, n, strict=True)):
        if k is not None and len(k) > 1:
            stacks.setdefault((len(k), int(m)), []).append(i)
    for (_, m), members in stacks.items():
        stack = lambda c: np.stack([np.asarray(c.iloc[i], float) for i in members])  # noqa: B023, E731
        for i, row in zip(members, splines(stack(knots), stack(values), np.arange(m, dtype=float)), strict=True):
            out[i] = row
    return pd.Series(out)


@kernel_udf(DOUBLES)
def spectrum(a: pd.Series) -> pd.Series:
    """Magnitudes at the positive frequencies, divided by their Euclidean norm (all zeros stay)."""

    def kernel(x: np.ndarray, _) -> list:
        m = np.abs(np.fft.rfft(x, axis=1))[:, 1 : (x.shape[1] + 1) // 2]
        return list(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))

    return by_length(a, kernel)


@kernel_udf(DOUBLES)
def median_of_each(cycles: pd.Series) -> pd.Series:
    """Median over the cycles of a list, position by position; they have one length. Null without a cycle."""
    return pd.Series([np.median(np.stack([np.asarray(c, float) for c in cs]), axis=0) if cs is not None and len(cs) else None for cs in cycles])


def fourier_resampled(x: np.ndarray, m: int) -> np.ndarray:
    """Stacked rows at length m by their Fourier coefficients. Low bins stay; the middle bin of an even shorter side is shared or merged."""
    n = x.shape[1]
    k = min(n, m)
    bins = np.fft.rfft(x, axis=1)
    out = np.zeros((len(x), m // 2 + 1), complex)
    out[:, : k // 2 + 1] = bins[:, : k // 2 + 1]
    if k % 2 == 0:
        out[:, k // 2] *= 2.0 if m < n else 0.5 if m > n else 1.0
    return np.fft.irfft(out, m, axis=1) * (m / n)


def normed(cycles: pd.Series, length: int, eps: float = 1e-6) -> list[np.ndarray | None]:
    """For each list its cycles at ``length`` samples and scaled to [0, 1], stacked; the cycles of a slice are resampled by length. Empty cycles go."""
    out: list[np.ndarray | None] = []
    stacks: dict[int, list[tuple[int, int, object]]] = {}
    for row, cs in enumerate(cycles):
        held = [c for c in cs if len(c)] if cs is not None else None
        out.append(None if held is None else np.empty((len(held), length)))
        for place, c in enumerate(held or ()):
            stacks.setdefault(len(c), []).append((row, place, c))
    for members in stacks.values():
        made = fourier_resampled(np.stack([np.asarray(c, float) for *_, c in members]), length)
        low, high = made.min(axis=1, keepdims=True), made.max(axis=1, keepdims=True)
        for (row, place, _), scaled in zip(members, (made - low) / (high - low + eps), strict=True):
            out[row][place] = scaled
    return out


def median_normed(length: int, eps: float = 1e-6):
    """Median, position by position, of the cycles of a list at ``length`` samples and scaled to [0, 1]; null without a cycle.

    One kernel for the three steps, so that the cycles come to Python once and
    only their median goes back.
    """

    @kernel_udf(DOUBLES)
    def apply(cycles: pd.Series) -> pd.Series:
        return pd.Series([np.median(h, axis=0) if h is not None and len(h) else None for h in normed(cycles, length, eps)])

    return apply


def deviations(c: np.ndarray) -> np.ndarray:
    """Distance of each sample from the line between the first and the last of its row, in the form of the published curve."""
    last = c.shape[1] - 1
    first, rise = c[:, :1], c[:, -1:] - c[:, :1]
    return (c * rise * np.arange(last + 1) - c * last + first * last) / np.sqrt(rise * rise + last * last)


def block_means(curves: np.ndarray, width: int = 3) -> np.ndarray:
    """Means of consecutive blocks that end before the last sample."""
    n = (curves.shape[1] - 1) // width
    return curves[:, : n * width].reshape(len(curves), n, width).sum(axis=2) / width


def slope_curves(length: int, raw: bool):
    """[rise, fall]: blocks of deviations of each cycle up to its largest sample, at length/4, and from it, at 3 length/4, as means over the cycles of a list; null without a cycle.

    ``raw`` cycles are resampled and scaled first, in the same kernel.
    """

    @kernel_udf(T.ArrayType(DOUBLES))
    def apply(cycles: pd.Series) -> pd.Series:
        held = normed(cycles, length) if raw else cycles
        stacks: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = {}
        curves: list[list] = []
        for row, cs in enumerate(held):
            curves.append([None] * (len(cs) if cs is not None else 0))
            for place, c in enumerate(cs if cs is not None else ()):
                c = np.asarray(c, float)
                stacks.setdefault((len(c), int(c.argmax())), []).append((row, place, c))
        for (_, top), members in stacks.items():
            x = np.stack([c for *_, c in members])
            up = block_means(deviations(fourier_resampled(x[:, : top + 1], length // 4)))
            down = block_means(deviations(fourier_resampled(x[:, top:], length // 4 * 3)))
            for (row, place, _), u, d in zip(members, up, down, strict=True):
                curves[row][place] = (u, d)
        return pd.Series([[sum(side) / len(side) for side in zip(*both, strict=True)] if both else None for both in curves])

    return apply


@kernel_udf(T.ArrayType(DOUBLES))
def resample_each(cycles: pd.Series, m: pd.Series) -> pd.Series:
    """Each cycle of a list at length m, by its Fourier coefficients; the cycles of a batch are stacked by length. Empty cycles go."""
    out: list = [None] * len(cycles)
    stacks: dict[tuple[int, int], list[tuple[int, int, object]]] = {}
    for row, (cs, k) in enumerate(zip(cycles, m, strict=True)):
        if cs is not None:
            held = [c for c in cs if len(c)]
            out[row] = [None] * len(held)
            for place, c in enumerate(held):
                stacks.setdefault((len(c), int(k)), []).append((row, place, c))
    for (_, k), members in stacks.items():
        for (row, place, _), made in zip(members, fourier_resampled(np.stack([np.asarray(c, float) for *_, c in members]), k), strict=True):
            out[row][place] = made
    return pd.Series(out)
