"""Smooth resampling of series: cubic splines, polyphase filters, polynomial fits, envelopes and normalised pulses.

Each works on series packed into rows (operators.filters.packed), in Arrow batches; splines of equally long series of a
batch are solved together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.filters import Step, each, envelope, matrices, packed


def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives at the knots of the cubic splines through y (..., n), at knots x, whose outer two pieces on either side are one polynomial."""
    n, h = len(x), np.diff(x)
    d = np.diff(y) / h
    if n == 2:
        return np.repeat(d, 2, -1)
    if n == 3:  # one parabola
        a = (d[..., 1] - d[..., 0]) / (x[2] - x[0])
        return np.stack([d[..., 0] - a * h[0], d[..., 0] + a * h[0], d[..., 1] + a * h[1]], -1)
    low, mid, up = np.zeros(n), np.zeros(n), np.zeros(n)
    right = np.zeros(y.shape)
    low[1:-1], mid[1:-1], up[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right[..., 1:-1] = 3 * (h[1:] * d[..., :-1] + h[:-1] * d[..., 1:])
    mid[0], up[0] = h[1], h[0] + h[1]
    right[..., 0] = ((h[0] + 2 * up[0]) * h[1] * d[..., 0] + h[0] ** 2 * d[..., 1]) / up[0]
    mid[-1], low[-1] = h[-2], h[-1] + h[-2]
    right[..., -1] = (h[-1] ** 2 * d[..., -2] + (2 * low[-1] + h[-1]) * h[-2] * d[..., -1]) / low[-1]
    for i in range(1, n):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        right[..., i] -= f * right[..., i - 1]
    out = np.empty(y.shape)
    out[..., -1] = right[..., -1] / mid[-1]
    for i in range(n - 2, -1, -1):
        out[..., i] = (right[..., i] - up[i] * out[..., i + 1]) / mid[i]
    return out


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic splines through (x, y) at the places `at`; one sample is a constant, two a line, three a parabola."""
    if len(x) == 1:
        return np.repeat(y, len(at), -1)
    s = slopes(x, y)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = (x[1:] - x[:-1])[i]
    u = (at - x[i]) / h
    a, b = y[..., i], y[..., i + 1]
    return a * (1 + 2 * u) * (1 - u) ** 2 + b * u**2 * (3 - 2 * u) + h * u * (1 - u) * (s[..., i] * (1 - u) - s[..., i + 1] * u)


def to_length(v: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Rows of a padded matrix as `size` samples each, evenly spaced from the first to the last, on their splines."""
    out = np.full((len(v), size), np.nan)
    for k in np.unique(n[n > 0]):
        same = np.flatnonzero(n == k)
        out[same] = spline(np.linspace(0, 1, k), v[same, :k], np.linspace(0, 1, size))
    return out


def kaiser_taps(up: int, down: int, beta: float = 2.0) -> np.ndarray:
    """Low-pass at the lower of both rates: ten periods of the wider step on either side, under a Kaiser window, gain `up`."""
    wide = max(up, down)
    x = np.arange(-10 * wide, 10 * wide + 1)
    h = np.sinc(x / wide) * np.kaiser(len(x), beta)
    return h / h.sum() * up


def polyphase(up: int, down: int, beta: float = 2.0) -> Callable[[np.ndarray], np.ndarray]:
    """A series' samples at up / down of its rate; beyond its ends it is 0."""
    taps = kaiser_taps(up, down, beta)
    half = len(taps) // 2

    def run(v: np.ndarray) -> np.ndarray:
        m = np.arange(-(-len(v) * up // down)) * down
        j = np.arange(-(half // up) - 1, half // up + 2) + (m // up)[:, None]
        tap = m[:, None] - j * up + half
        good = (j >= 0) & (j < len(v)) & (tap >= 0) & (tap < len(taps))
        return np.where(good, v[np.clip(j, 0, len(v) - 1)] * taps[np.clip(tap, 0, len(taps) - 1)], 0.0).sum(1)

    return run


def polynomial(degree: int) -> Callable[[np.ndarray], np.ndarray]:
    """The least-squares polynomial at every sample; samples that aren't finite don't count."""

    def run(v: np.ndarray) -> np.ndarray:
        at = np.linspace(0, len(v), len(v))
        good = np.isfinite(v)
        if not good.any():
            return v
        fit = np.polynomial.Polynomial.fit(at[good], v[good], min(degree, int(good.sum()) - 1), domain=[0, max(len(v), 1)])
        return fit(at)

    return run


def envelopes(v: np.ndarray, rate: float, divisor: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower envelope of a series: splines through its strict extrema, at the ends the mean of the four values beside them; NaN without two extrema."""
    reach = max(int(rate / divisor), 1)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(v, reach, constant_values=np.nan), 2 * reach + 1) if len(v) else np.zeros((0, 2 * reach + 1))
    others = np.delete(around, reach, 1)
    out = []
    for sign in (1, -1):
        inner = np.arange(len(v))
        found = np.flatnonzero(np.all(~(sign * others >= sign * v[:, None]), 1) & (inner > 0) & (inner < len(v) - 1)) if len(v) else np.zeros(0, int)
        if len(found) < 2:
            out.append(np.full(len(v), np.nan))
            continue
        at = np.arange(found[0], found[-1] + 1)
        e = np.full(len(v), np.nan)
        e[at] = spline(found.astype(float), v[found], at.astype(float))
        e[: found[0]] = e[found[0] + 1 : found[0] + 5].mean() if len(at) > 1 else e[found[0]]
        e[found[-1] + 1 :] = e[max(found[-1] - 4, found[0]) : found[-1]].mean() if len(at) > 1 else e[found[-1]]
        out.append(e)
    return out[0], out[1]


def normal_pulse(v: np.ndarray, upward: bool = True) -> tuple[np.ndarray, int, bool]:
    """A pulse's distance from its chord over the highest one; where that is; is it there in time (in the first 60 %; downward: not in the first 40 %)?"""
    n = len(v)
    flat = np.abs(v - np.linspace(v[0], v[-1], n))
    peak = int(np.argmax(flat))
    usable = peak <= int(n * 0.6) if upward else peak >= int(n * 0.4)
    top = flat[peak]
    flat = flat / top if top > 0 else flat
    return (flat if upward else flat.max() - flat), peak, usable


# on frames


def _exploded(x: DataFrame, f, keys: tuple[str, ...], order: str, names: tuple[str, ...] = ("v",)) -> DataFrame:
    """keys, i (from 0) and the columns that f(matrix, lengths) gives: a list of arrays for each series and name."""
    rows = packed(x, keys, order).drop("t")
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c in keys)

    def run(batches):
        for part, v, n in matrices(batches):
            found = f(v, n)
            lists = []
            for one in found:
                flat = np.concatenate([*one, np.zeros(0)])
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in one])]).astype(np.int32)), pa.array(flat, mask=~np.isfinite(flat))))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *lists], [*keys, *names])

    done = rows.mapInArrow(run, f"{kinds}, {', '.join(f'{c} array<double>' for c in names)}")
    told = done.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("i", "_s"))
    return told.select(*keys, F.col("i").cast("long").alias("i"), *(F.col(f"_s.{c}").alias(c) for c in names))


def upsampled(x: DataFrame, size: int, keys: tuple[str, ...] = ("k",), order: str = "t") -> DataFrame:
    """`size` samples of each series on its cubic spline."""
    return _exploded(x, lambda v, n: [list(to_length(v, n, size))], keys, order)


def resampled(x: DataFrame, up: int, down: int, keys: tuple[str, ...] = ("k",), order: str = "t") -> DataFrame:
    f = polyphase(up, down)
    return _exploded(x, lambda v, n: [[f(v[i, :k]) for i, k in enumerate(n)]], keys, order)


def second_differences(x: DataFrame, size: int, degree: int = 15, keys: tuple[str, ...] = ("k",), order: str = "t") -> DataFrame:
    """Each pulse as `size` samples, differenced twice (times `size` each), and a polynomial through that."""
    f = polynomial(degree)
    return _exploded(x, lambda v, n: [[f(np.diff(y, 2) * size**2) if k else np.zeros(0) for y, k in zip(to_length(v, n, size), n, strict=True)]], keys, order)


def normal_pulses(x: DataFrame, size: int, upward: bool = True, keys: tuple[str, ...] = ("k",), order: str = "t") -> DataFrame:
    """Each pulse as `size` samples, normalised; peak and usable stand on every row."""

    def run(v: np.ndarray, n: np.ndarray) -> list[list[np.ndarray]]:
        found = [normal_pulse(y, upward) for y in to_length(v, n, size)]
        return [[y for y, _, _ in found], *([np.full(size, float(r[c])) for r in found] for c in (1, 2))]

    told = _exploded(x, run, keys, order, ("v", "peak", "usable"))
    return told.select(*keys, "i", "v", F.col("peak").cast("long").alias("peak"), (F.col("usable") == 1).alias("usable"))


def enveloped(x: DataFrame, rate: float, keys: tuple[str, ...] = ("k",), order: str = "t") -> DataFrame:
    """The upper and lower envelope of each series."""

    def run(v: np.ndarray, n: np.ndarray) -> list[list[np.ndarray]]:
        found = [envelopes(v[i, :k], rate) for i, k in enumerate(n)]
        return [[up for up, _ in found], [low for _, low in found]]

    return _exploded(x, run, keys, order, ("upper", "lower"))


def fitted(degree: int) -> Step:
    """polynomial() as a step of a chain."""
    return each(polynomial(degree))


def interval_spectrum(gaps: DataFrame, rate: float = 2.0) -> DataFrame:
    """gaps (k, t, ibi in seconds, null where implausible): magnitudes of the evenly sampled intervals below half the rate.

    Nulls lie on the line between their neighbours; the spline goes through the intervals at the times when they end.
    """

    def one(v: np.ndarray) -> np.ndarray:
        good = np.flatnonzero(np.isfinite(v))
        if len(good) < 2:
            return np.zeros(0)
        v = np.interp(np.arange(len(v)), good, v[good])
        at = np.cumsum(v)
        even = spline(at, v, at[0] + np.arange(int(np.ceil((at[-1] - at[0]) * rate - 1e-9))) / rate)  # a last place that only rounding keeps from the end is the end
        return np.abs(np.fft.fft(even))[: -(-len(even) // 2)]

    x = gaps.select("k", "t", F.col("ibi").alias("v"))
    return _exploded(x, lambda v, n: [[one(v[i, :k]) for i, k in enumerate(n)]], ("k",), "t")


def at_times(x: DataFrame, time: str, rate: float, whole_seconds: bool = False, skip: float = 0.0) -> DataFrame:
    """k, i, v: samples of each series (k, time, v) on the cubic spline through its samples, the first of those with one time.

    int(rate * span) samples from the first time to the last. With whole_seconds, as for clock times, from the whole second
    at or before the first time, plus `skip`, to the one at or before the last: what lies before the first sample goes on by
    the spline's outer piece.
    """
    from tidewave.operators.signal import first_of_time

    rows = first_of_time(x.select("k", F.col(time).cast("double").alias("at"), "v").where("at is not null and v is not null"), "at", ["v"])
    series = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("_s")).select("k", F.col("_s.at").alias("at"), F.col("_s.v").alias("v"))

    def run(batches):
        for batch in batches:
            lists = []
            for at, v in zip(batch.column("at"), batch.column("v"), strict=True):
                a, y = (c.values.to_numpy(zero_copy_only=False).astype(float) for c in (at, v))
                first, last = (int(a[0]) + skip, int(a[-1])) if whole_seconds else (a[0], a[-1])
                lists.append(spline(a, y, np.linspace(first, last, max(int(rate * (last - first)), 0))))
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(y) for y in lists])]).astype(np.int32)), pa.array(np.concatenate([*lists, np.zeros(0)])))
            yield pa.RecordBatch.from_arrays([batch.column("k"), values], ["k", "v"])

    return series.mapInArrow(run, "k long, v array<double>").select("k", F.posexplode("v").alias("i", "v")).select("k", F.col("i").cast("long").alias("i"), "v")


def over_envelope(x: DataFrame, keys: tuple[str, ...] = ("k",), order: str = "t") -> DataFrame:
    """keys, i, v, envelope: each series over the magnitude of its analytic signal, and that magnitude (zeros as 1e-8)."""

    def run(v: np.ndarray, n: np.ndarray) -> list[list[np.ndarray]]:
        sizes = [envelope(v[i, :k]) for i, k in enumerate(n)]
        sizes = [np.where(s == 0, 1e-8, s) for s in sizes]
        return [[v[i, :k] / s for i, (k, s) in enumerate(zip(n, sizes, strict=True))], sizes]

    return _exploded(x, run, keys, order, ("v", "envelope"))
