"""True recurrences on series, run over many series at once; and distances of two series.

A series is packed into one row (a recording: minutes, not years), rows go to Python in Arrow batches, and every step works
on a matrix of the batch's series: the loop over time is Python's, the series are numpy's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions.windows import gradient, series, whole

#: Samples of a matrix that a task works on at a time; one longer series is a matrix of its own.
SAMPLES = 1 << 20


class Step:
    """A step on the rows of a matrix, of which each has its own length; what is beyond it is padding. Called, it takes one series."""

    def __init__(self, rows: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.rows = rows

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return self.rows(np.asarray(v, float)[None, :], np.asarray([len(v)]))[0]


def detrend(rate: float) -> Step:
    """Smoothness priors with lambda = 12 * rate, by elimination in five diagonals; the end is repeated for two seconds and cut off."""

    def run(v: np.ndarray, n: np.ndarray) -> np.ndarray:
        more = np.minimum(n, int(2 * rate))
        size = n + more
        m, w = int(size.max(initial=0)), (12 * rate) ** 2
        at = np.arange(m)
        inside = at < size[:, None]
        p = np.where(inside, np.take_along_axis(v, np.clip(np.where(at < n[:, None], at, at - more[:, None]), 0, v.shape[1] - 1), 1), 0.0)
        last = at < size[:, None] - 2  # rows of the second difference, which starts at the place
        main, one, two = np.ones(p.shape), np.zeros(p.shape), np.zeros(p.shape)
        for i, c in enumerate((1.0, 4.0, 1.0)):
            main[:, i:] += w * c * last[:, : m - i]
        one += -2 * w * last
        one[:, 1:] += -2 * w * last[:, : m - 1]
        two += w * last
        d, a, b, z = np.ones((m + 2, len(v))), np.zeros((m + 2, len(v))), np.zeros((m + 2, len(v))), np.zeros((m + 2, len(v)))
        main, one, two, p = main.T, one.T, two.T, p.T
        for i in range(m):  # L D L', the places before the first are 0
            d[i] = main[i] - a[i - 1] ** 2 * d[i - 1] - b[i - 2] ** 2 * d[i - 2]
            a[i] = (one[i] - a[i - 1] * d[i - 1] * b[i - 1]) / d[i]
            b[i] = two[i] / d[i]
            z[i] = p[i] - a[i - 1] * z[i - 1] - b[i - 2] * z[i - 2]
        z /= d
        for i in range(m - 2, -1, -1):
            z[i] -= a[i] * z[i + 1] + b[i] * z[i + 2]
        out = (p - z[:m]).T[:, : v.shape[1]]
        short = n < 5
        if short.any():
            mean = np.nansum(np.where(np.arange(v.shape[1]) < n[:, None], v, 0), 1) / np.maximum(n, 1)
            out[short] = (v - mean[:, None])[short]
        return out

    return Step(run)


def _butterworth(order: int, low: float, high: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Band-pass by the bilinear transform of the analogue prototype's poles."""
    u, v = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * (v - u) / 2
    root = np.sqrt(poles * poles - u * v)
    poles = np.concatenate([poles + root, poles - root])
    z = (2 * rate + poles) / (2 * rate - poles)
    b = np.real(np.poly(np.concatenate([np.ones(order), -np.ones(order)])))
    a = np.real(np.poly(z))
    mid = np.exp(2j * np.arctan(np.sqrt(np.tan(np.pi * low / rate) * np.tan(np.pi * high / rate))))
    return b * abs(np.polyval(a, mid) / np.polyval(b, mid)), a


def _lowpass(order: int, cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * rate * np.tan(np.pi * cutoff / rate)
    poles = w * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    a = np.real(np.poly((2 * rate + poles) / (2 * rate - poles)))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed along the last axis, from the state that a constant first sample would have left."""
    n = len(a) - 1
    m = np.eye(n) - np.column_stack([-a[1:], np.eye(n)[:, :-1]])
    one = x.ndim == 1
    x = np.atleast_2d(x)
    state = np.vstack([np.linalg.solve(m, b[1:] - a[1:] * b[0])[:, None] * x[:, 0], np.zeros(len(x))])
    y = np.empty(x.T.shape)
    ahead, back = b[1:, None], a[1:, None]
    for i, v in enumerate(np.ascontiguousarray(x.T)):
        y[i] = b[0] * v + state[0]
        state[:-1] = state[1:] + ahead * v - back * y[i]
    return y[:, 0] if one else y.T


def _both_ways(b: np.ndarray, a: np.ndarray) -> Step:
    """Forward and backward over the series with its ends reflected; NaN if it is no longer than the reflection."""
    pad = 3 * len(a)

    def run(v: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.full(v.shape, np.nan)
        able = n > pad
        if not able.any():
            return out
        x, k = v[able], n[able][:, None]
        at = np.arange(int(k.max()) + 2 * pad) - pad
        pick = lambda i: np.take_along_axis(x, np.clip(i, 0, x.shape[1] - 1), 1)
        places = np.broadcast_to(at, (len(x), len(at)))
        long = np.where(places < 0, 2 * x[:, :1] - pick(-places), np.where(places >= k, 2 * pick(k - 1) - pick(2 * (k - 1) - places), pick(places)))
        turned = np.clip(k + 2 * pad - 1 - np.arange(len(at)), 0, len(at) - 1)
        y = _filter(b, a, np.take_along_axis(_filter(b, a, long), turned, 1))
        y = np.take_along_axis(y, turned, 1)[:, pad:-pad]
        out[able] = np.pad(y, ((0, 0), (0, v.shape[1] - y.shape[1])))
        return out

    return Step(run)


def bandpass(low: float, high: float, rate: float, order: int = 1) -> Step:
    return _both_ways(*_butterworth(order, low, high, rate))


def lowpass(cutoff: float, rate: float, order: int = 4) -> Step:
    return _both_ways(*_lowpass(order, cutoff, rate))


def smoothing(n: int, degree: int) -> np.ndarray:
    """Row i: the weights of n samples that give the least-squares polynomial at the i-th of them."""
    basis = np.vander(np.arange(n) - (n - 1) / 2, degree + 1, increasing=True)
    return basis @ np.linalg.pinv(basis)


def savitzky_golay(rate: float, degree: int = 5) -> Step:
    """Least-squares polynomial in a window of half a second (made odd); at the ends the first and last window's polynomial."""
    n = int(rate / 2) + 1
    n += 1 - n % 2
    h = n // 2
    smooth = smoothing(n, degree)

    def run(v: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = v.astype(float)
        able = np.flatnonzero(size >= n)
        if not len(able):
            return out
        x, k = v[able], size[able][:, None]
        inner = np.zeros(x.shape)
        for i, c in enumerate(smooth[h]):
            inner[:, h : x.shape[1] - h] += c * x[:, i : x.shape[1] - n + 1 + i]
        inner[:, :h] = x[:, :n] @ smooth[:h].T
        final = k - n + np.arange(n)
        np.put_along_axis(inner, final[:, h + 1 :], np.take_along_axis(x, final, 1) @ smooth[h + 1 :].T, 1)
        out[able] = inner
        return out

    return Step(run)


def envelope(v: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of one series."""
    n = len(v)
    gain = np.zeros(n)
    gain[:1] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2 : n // 2 + 1] = 1
    return np.abs(np.fft.ifft(np.fft.fft(v) * gain)) if n else v


def each(f: Callable[[np.ndarray], np.ndarray]) -> Step:
    """A function of one series as a step."""

    def run(v: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.full(v.shape, np.nan)
        for i, k in enumerate(n):
            out[i, :k] = f(v[i, :k])
        return out

    return Step(run)


def by_envelope() -> Step:
    """Divided by the magnitude of the analytic signal."""

    def run(v: np.ndarray) -> np.ndarray:
        size = envelope(v)
        return v / np.where(size == 0, 1e-8, size)

    return each(run)


def packed(x: DataFrame, keys: tuple[str, ...] = ("k",), order: str = "t", value: str = "v") -> DataFrame:
    """A row for each series: keys, t (its places in order) and v (its samples there)."""
    rows = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).cast("double").alias("v")))).alias("_s"))
    return rows.select(*keys, F.col("_s.t").alias("t"), F.col("_s.v").alias("v"))


def matrices(batches, column: str = "v"):
    """Slices of the batches of about SAMPLES samples, each with its series as a padded matrix and their lengths."""
    for batch in batches:
        lists = batch.column(column)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop, widest = start, 0
            while stop < batch.num_rows and (stop == start or max(widest, sizes[stop]) * (stop + 1 - start) <= SAMPLES):
                widest = max(widest, int(sizes[stop]))
                stop += 1
            part, n = batch.slice(start, stop - start), sizes[start:stop]
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(float)
            v = np.zeros((len(n), widest))
            v[np.arange(widest) < n[:, None]] = flat
            yield part, v, n
            start = stop


def apply_chain(x: DataFrame, steps: list[Step], keys: tuple[str, ...] = ("k",), order: str = "t", value: str = "v") -> DataFrame:
    """All steps on each series in one pass: one exchange on the keys. Nulls inside a series become null results."""

    def run(batches):
        for part, v, n in matrices(batches):
            for step in steps:
                v = step.rows(v, n)
            flat = v[np.arange(v.shape[1]) < n[:, None]]
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat, mask=~np.isfinite(flat)))
            yield pa.RecordBatch.from_arrays([*(values if c == "v" else part.column(c) for c in part.schema.names)], part.schema.names)

    rows = packed(x, keys, order, value)
    done = rows.mapInArrow(run, rows.schema)
    told = done.select(*keys, F.explode(F.arrays_zip("t", "v")).alias("_s"))
    return told.select(*keys, F.col("_s.t").alias(order), F.col("_s.v").alias(value))


def apply_blocks(x: DataFrame, steps: list[Step], block: int, halo: int, keys: tuple[str, ...] = ("k",), order: str = "t", value: str = "v") -> DataFrame:
    """apply_chain for series too long for one row: blocks of `block` places (order counts from 1), each with copies of `halo` places on either side.

    A series' blocks are rows of their own, dealt out by (keys, block), so one long series runs in many tasks. Steps see a
    block as a series that ends at its halo; what they put there is cut off. With a halo beyond the reach of the steps
    (detrending: some twenty seconds; a band-pass: some periods of its lower edge) the result is that of the whole series.
    """
    place = F.col(order) - 1
    first = F.greatest(F.floor((place - halo) / block), F.lit(0))
    rows = x.select(*keys, order, value, F.explode(F.sequence(first, F.floor((place + halo) / block))).alias("_block"))
    done = apply_chain(rows, steps, (*keys, "_block"), order, value)
    return done.where(F.floor(place / block) == F.col("_block")).select(*keys, order, value)


def onsets(x: DataFrame, rate: float) -> DataFrame:
    """Beat onsets: feet of the steepest rises at upward zero crossings, not nearer to the last one kept than 0.3 s: k, beat, t.

    The steepest sample lies within 0.2 s of the crossing, the trough in the 0.4 s before it; the foot is where the tangent
    there meets the trough's level. One window pass; the greedy choice is a fold over a series' few crossings.
    """
    near, back, apart = int(0.2 * rate), int(0.4 * rate), int(0.3 * rate)
    w = series("k", "t")
    rows = x.select("k", "t", "v", F.lead("v").over(w).alias("next"), gradient("v", w).alias("slope"), F.min("t").over(whole("k")).alias("t0"), F.max("t").over(whole("k")).alias("t1"))
    top = F.max(F.struct("slope", (-F.col("t")).alias("t"), "v")).over(w.rowsBetween(-near, near))
    low = F.min(F.struct("v", "t")).over(w.rowsBetween(-back, 0))
    at = rows.select("k", "t", "v", "next", "t0", "t1", top.alias("top"), low["v"].alias("trough")).where(f"v < 0 and next >= 0 and top.slope * {rate} > 1e-6")
    foot = F.rint(-F.col("top.t") - F.col("t0") + (F.col("trough") - F.col("top.v")) / F.col("top.slope"))
    foot = F.least(F.greatest(foot.cast("long"), F.lit(0)), F.col("t1") - F.col("t0")) + F.col("t0")
    crossings = at.select("k", "t", foot.alias("foot")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", "foot"))).alias("all"))
    kept = F.aggregate("all", F.expr("cast(array() as array<bigint>)"), lambda have, c: F.when((F.size(have) == 0) | (c["foot"] - F.coalesce(F.try_element_at(have, F.lit(-1)), F.lit(0)) >= apart), F.concat(have, F.array(c["foot"]))).otherwise(have))
    return crossings.select("k", F.posexplode(kept).alias("beat", "t")).select("k", (F.col("beat") + 1).cast("long").alias("beat"), "t")


def dtw(a: np.ndarray, b: np.ndarray, window: int | None = None, normalise: str | None = None) -> float:
    """Root of the least summed squared difference along a warping path.

    normalise: "len" divides the sum by the longer length, "path" by the steps of the path (of equal ones the one that goes
    up rather than left rather than both).
    """
    n, m = len(a), len(b)
    reach = max(window if window is not None else max(n, m), abs(n - m))
    above, steps = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
    above[0] = 0
    for i in range(1, n + 1):
        row, taken = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        low, high = max(1, i - reach), min(m, i + reach)
        cost = (a[i - 1] - b[low - 1 : high]) ** 2
        best = np.minimum(above[low : high + 1], above[low - 1 : high]).tolist()
        left = float(row[low - 1])
        for j, (c, over) in enumerate(zip(cost.tolist(), best, strict=True), low):  # the left neighbour is a recurrence
            least = min(over, left)
            taken[j] = 1 + (steps[j] if above[j] == least else taken[j - 1] if left == least else steps[j - 1])
            left = row[j] = c + least
        above, steps = row, taken
    total = above[m] / {None: 1, "len": max(n, m), "path": max(int(steps[m]), 1)}[normalise]
    return float(np.sqrt(total))


def dtw_many(a: np.ndarray, b: np.ndarray, n: np.ndarray, window: int | None = None, normalise: str | None = None) -> np.ndarray:
    """dtw() of the rows of two padded matrices, of which each pair has one length: all pairs and all cells of an anti-diagonal at a time.

    A cell (i, j) needs (i, j - 1) and (i - 1, j) of the diagonal before and (i - 1, j - 1) of the one before that.
    """
    pairs, longest = a.shape
    reach = longest if window is None else window
    one, two = (np.full((pairs, longest + 1), np.inf) for _ in range(2))
    one_steps, two_steps = (np.zeros((pairs, longest + 1), np.int64) for _ in range(2))
    one[:, 0] = 0
    total, taken = np.where(n == 0, 0.0, np.nan), np.zeros(pairs, np.int64)
    for d in range(1, 2 * longest + 1):
        low, high = max(1, d - longest, -(-(d - reach) // 2)), min(longest, d - 1, (d + reach) // 2)
        now, now_steps = np.full(one.shape, np.inf), np.zeros(one_steps.shape, np.int64)
        if low <= high:
            i = np.arange(low, high + 1)
            up, left, both = one[:, i - 1], one[:, i], two[:, i - 1]
            least = np.minimum(np.minimum(up, left), both)
            now[:, i] = (a[:, i - 1] - b[:, d - i - 1]) ** 2 + least
            now_steps[:, i] = 1 + np.where(up == least, one_steps[:, i - 1], np.where(left == least, one_steps[:, i], two_steps[:, i - 1]))
        done = np.flatnonzero(2 * n == d)
        total[done], taken[done] = now[done, n[done]], now_steps[done, n[done]]
        two, two_steps, one, one_steps = one, one_steps, now, now_steps
    return np.sqrt(total / {None: 1, "len": np.maximum(n, 1), "path": np.maximum(taken, 1)}[normalise])


def pair_distances(pairs: DataFrame, window: int | None = None, normalise: str | None = None, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """pairs (k, t, a, b): the warping distance of each series' two signals, some pairs at a time."""
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))).alias("_s"))
    rows = rows.select(*keys, F.col("_s.a").alias("a"), F.col("_s.b").alias("b"))
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c in keys)

    def run(batches):
        for part, a, n in matrices(batches, "a"):
            b = np.zeros(a.shape)
            b[np.arange(a.shape[1]) < n[:, None]] = part.column("b").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), pa.array(dtw_many(a, b, n, window, normalise))], [*keys, "dtw"])

    return rows.mapInArrow(run, f"{kinds}, dtw double")
