"""Beats of a signal: from valley to valley, their statistics, acceptance, quality index, ranges and contour features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.windows import gradient, is_extreme, series
from tidewave.operators.filters import apply_chain, bandpass, matrices, onsets, packed
from tidewave.operators.signal import peaks
from tidewave.operators.waves import to_length, upsampled

#: The least quality index of a good beat.
THRESHOLDS = {"conservative": 0.796, "non-conservative": 0.3}
LEVELS = (10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90)


def cut(x: DataFrame, reach: int) -> DataFrame:
    """k, beat (from 1), pos (from 0), t, v: rows from each valley to the next; what is before the first and after the last goes."""
    w = series("k", "t")
    marked = x.select("k", "t", "v", is_extreme("v", w, reach, low=True).cast("long").alias("low"))
    ids = marked.select("k", "t", "v", F.sum("low").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("beat"), F.sum("low").over(Window.partitionBy("k")).alias("beats"))
    return ids.where("beat > 0 and beat < beats").select("k", "beat", (F.row_number().over(series(["k", "beat"], "t")) - 1).cast("long").alias("pos"), "t", "v")


def cut_with_margin(x: DataFrame, reach: int, margin: int) -> DataFrame:
    """k, beat, pos (from 0), t, v: beats that begin `margin` samples before their valley, which is at pos = margin, so neighbours overlap.

    Every sample goes to its own beat and to those whose valley comes within the margin; all from one sort. A beat whose
    margin would begin before the series is left out, as is what follows the last valley.
    """
    w = series("k", "t")
    marked = x.select("k", "t", "v", is_extreme("v", w, reach, low=True).cast("long").alias("low"))
    ids = marked.select("k", "t", "v", F.sum("low").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("own"), F.sum("low").over(w.rangeBetween(Window.unboundedPreceding, margin)).alias("last"), F.sum("low").over(Window.partitionBy("k")).alias("beats"))
    rows = ids.where("last > 0").select("k", "t", "v", "own", "beats", F.explode(F.sequence(F.greatest("own", F.lit(1)), "last")).alias("beat")).where("beat < beats")
    placed = rows.select("k", "beat", (F.row_number().over(series(["k", "beat"], "t")) - 1).cast("long").alias("pos"), "t", "v", F.count(F.when(F.col("own") < F.col("beat"), 1)).over(Window.partitionBy("k", "beat")).alias("ahead"))
    return placed.where(F.col("ahead") == margin).drop("ahead")


def without_margin_chord(beats: DataFrame, margin: int) -> DataFrame:
    """Beats less the line from their valley to their last sample; the margin before the valley stays."""
    every = Window.partitionBy("k", "beat")
    valley, last, n = F.max(F.when(F.col("pos") == margin, F.col("v"))).over(every), F.max_by("v", "pos").over(every), F.max("pos").over(every)
    line = valley + (last - valley) * (F.col("pos") - margin) / F.greatest(n - margin, F.lit(1))
    return beats.select("k", "beat", "pos", F.when(F.col("pos") < margin, F.col("v")).otherwise(F.col("v") - line).alias("v"))


def margin_statistics(beats: DataFrame, margin: int, digits: int = 6) -> DataFrame:
    """k, beat, area, duration, amplitude of what follows the valley, and good: whether the second differences, margin included, have the order of waves a to e."""
    own = beats.where(F.col("pos") >= margin).groupBy("k", "beat").agg(F.sum("v").alias("area"), F.count(F.lit(1)).alias("duration"), F.max("v").alias("amplitude"))
    w = series(["k", "beat"], "pos")
    twice = (F.lead("v", 2).over(w) - F.lead("v").over(w)) - (F.lead("v").over(w) - F.col("v"))
    second = without_margin_chord(beats, margin).select("k", "beat", "pos", F.round(twice, digits).alias("v")).where("v is not null")
    return own.join(check_second_derivative(second), ["k", "beat"], "left").withColumn("good", F.coalesce("good", F.lit(False)))


def representative_with_margin(beats: DataFrame, chosen: DataFrame, size: int, margin: int) -> DataFrame:
    """k, pos, v: the mean of each series' chosen beats, margin included, each over its amplitude and on `size` points of its spline; from its
    first valley on less the line from there to the end, moved to where the valley was, so that the pieces meet; scaled 0 to 2.

    A mean without an inner valley is corrected from its first point on.
    """
    own = beats.join(chosen, ["k", "beat"], "left_semi")
    top = F.max(F.when(F.col("pos") >= margin, F.col("v"))).over(Window.partitionBy("k", "beat"))
    even = upsampled(own.select("k", "beat", "pos", F.try_divide("v", top).alias("v")), size, ("k", "beat"), "pos")
    mean = even.groupBy("k", "i").agg(F.avg("v").alias("v"))
    valley = peaks(mean.withColumnRenamed("i", "t"), low=True).groupBy("k").agg(F.min("t").alias("at"))
    rows = mean.join(valley, "k", "left").withColumn("at", F.coalesce("at", F.lit(0)))
    every = Window.partitionBy("k")
    rows = rows.select("k", "i", "v", "at", F.max(F.when(F.col("i") == F.col("at"), F.col("v"))).over(every).alias("from"), F.max_by("v", "i").over(every).alias("to"))
    line = F.col("from") + (F.col("to") - F.col("from")) * (F.col("i") - F.col("at")) / F.greatest(size - 1 - F.col("at"), F.lit(1))
    flat = rows.select("k", "i", F.when(F.col("i") < F.col("at"), F.col("v")).otherwise(F.col("v") - line + F.col("from")).alias("v"))
    low, span = F.min("v").over(every), F.max("v").over(every) - F.min("v").over(every)
    return flat.select("k", F.col("i").alias("pos"), F.when(span <= 1e-8, F.lit(0.0)).otherwise((F.col("v") - low) / F.nullif(span, F.lit(0.0)) * 2).alias("v"))


def between_onsets(x: DataFrame, starts: DataFrame) -> DataFrame:
    """k, beat, pos, t, v: rows from each onset (k, t) to the next. A series' onsets are joined to its rows as one array, by the exchange on k that the onsets came from."""
    lows = starts.groupBy("k").agg(F.collect_list("t").alias("lows"))
    marked = x.select("k", "t", "v").join(lows, "k")
    ids = marked.select("k", "t", "v", F.size(F.filter("lows", lambda low: low <= F.col("t"))).cast("long").alias("beat"), F.size("lows").alias("beats"))
    return ids.where("beat > 0 and beat < beats").select("k", "beat", (F.row_number().over(series(["k", "beat"], "t")) - 1).cast("long").alias("pos"), "t", "v")


def waveform_quality(x: DataFrame, rate: float, points: int = 30, mode: str = "non-conservative") -> DataFrame:
    """k, beat, start, end (seconds), sqi, good: the beats of a band-passed signal between its onsets, and how alike each is to the next.

    The index is the correlation of the second derivatives of both on `points` points of their splines; the last beat has
    none and isn't good.
    """
    flat = apply_chain(x, [bandpass(0.4, 10.0, rate, 5)])
    cuts = between_onsets(flat, onsets(flat, rate))
    told = alike(whole_beats(cuts), points)
    return good(told.select("k", "beat", ((F.col("first") - 1) / rate).alias("start"), (F.col("last") / rate).alias("end"), "sqi"), THRESHOLDS[mode])


def good_times(marked: DataFrame) -> DataFrame:
    """k, start, end of each run of good beats of waveform_quality."""
    w = series("k", "beat")
    runs = marked.where("good").withColumn("run", F.col("beat") - F.row_number().over(w))
    return runs.groupBy("k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def statistics(beats: DataFrame) -> DataFrame:
    """Area, duration and amplitude of each beat above the line from its first to its last sample."""
    w = series(["k", "beat"], "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, n = F.first("v").over(w), F.last("v").over(w), F.count(F.lit(1)).over(w)
    flat = beats.select("k", "beat", (F.col("v") - (first + (last - first) * F.col("pos") / F.greatest(n - 1, F.lit(1)))).alias("v"))
    return flat.groupBy("k", "beat").agg(F.sum("v").alias("area"), F.count(F.lit(1)).alias("duration"), F.max("v").alias("amplitude"))


def near_mean(columns: tuple[str, ...] = ("area", "duration", "amplitude"), digits: int = 9) -> Column:
    """Is a beat within one population deviation of its series' mean in every column, both rounded? Of two beats each is just at it."""
    w = Window.partitionBy("k")
    near: Column = F.lit(True)
    for c in columns:
        near = near & (F.round(F.abs(F.col(c) - F.avg(c).over(w)), digits) <= F.round(F.stddev_pop(c).over(w), digits))
    return near


def usual(stats: DataFrame, columns: tuple[str, ...] = ("area", "duration", "amplitude")) -> DataFrame:
    """Beats within one population deviation of their series' mean in every column."""
    return stats.withColumn("_near", near_mean(columns)).where("_near").drop("_near")


def quality(beats: DataFrame, order: int = 2) -> DataFrame:
    """k, beat, sqi: correlation of each beat's derivative with the next one's at equal positions; null for the last and flat ones."""
    w = series(["k", "beat"], "pos")
    for _ in range(order):
        beats = beats.withColumn("v", gradient("v", w))
    other = beats.select("k", (F.col("beat") - 1).alias("beat"), "pos", F.col("v").alias("next"))
    both = beats.join(other, ["k", "beat", "pos"], "left")
    return both.groupBy("k", "beat").agg(F.try_divide(F.covar_pop("v", "next"), F.when(F.count("next") > 0, F.stddev_pop(F.when(F.col("next").isNotNull(), F.col("v"))) * F.stddev_pop("next"))).alias("sqi"))


def whole_beats(cuts: DataFrame) -> DataFrame:
    """A row for each beat of cuts (k, beat, t, v): k, beat, first and last (of t), n, area, amplitude, v (its samples in order) and next (those of the next beat; none: empty). No exchange if the cuts lie by k."""
    rows = cuts.groupBy("k", "beat").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"), F.sum("v").alias("area"), F.max("v").alias("amplitude"), F.array_sort(F.collect_list(F.struct("t", F.col("v").cast("double").alias("v")))).alias("_s"))
    rows = rows.withColumn("v", F.col("_s.v")).drop("_s")
    w = series("k", "beat")
    return rows.withColumn("next", F.when(F.lead("beat").over(w) == F.col("beat") + 1, F.lead("v").over(w))).withColumn("next", F.coalesce("next", F.array().cast("array<double>")))


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices; NaN where one is flat."""
    a, b = (x - x[:, :1] for x in (a, b))  # so that a flat row is exactly so
    a, b = (x - x.mean(1, keepdims=True) for x in (a, b))
    size = np.sqrt((a * a).mean(1)) * np.sqrt((b * b).mean(1))
    return np.divide((a * b).mean(1), size, out=np.full(len(a), np.nan), where=size > 0)


def alike(rows: DataFrame, points: int, orders: dict[str, int] | None = None, least: int = 1) -> DataFrame:
    """rows of whole_beats, next dropped, with columns of quality(): how alike each beat is to the next one, both on `points` points of their splines.

    orders: the columns' names and which derivative they compare. Beats under `least` samples have no index, nor has the one before.
    """
    orders = orders or {"sqi": 2}
    names = [c for c in rows.columns if c != "next"]

    def run(batches):
        for part, v, n in matrices(batches):
            lists = part.column("next")
            m = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            w = np.zeros((len(m), int(m.max(initial=0))))
            w[np.arange(w.shape[1]) < m[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            both = [to_length(y, np.where(k < least, 0, k), points) for y, k in ((v, n), (w, m))]
            found = []
            for order in orders.values():
                a, b = both
                for _ in range(order):
                    a, b = np.gradient(a, axis=1), np.gradient(b, axis=1)
                c = correlations(a, b)
                found.append(pa.array(c, mask=~np.isfinite(c)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *found], [*names, *orders])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), *(f"{c} double" for c in orders)]))


def good(sqi: DataFrame, least: float) -> DataFrame:
    return sqi.withColumn("good", F.coalesce(F.col("sqi") >= least, F.lit(False)))


def ranges(marked: DataFrame) -> DataFrame:
    """First and last beat of each run of good ones."""
    w = series("k", "beat")
    runs = marked.where("good").withColumn("run", F.col("beat") - F.row_number().over(w))
    return runs.groupBy("k", "run").agg(F.min("beat").alias("first"), F.max("beat").alias("last")).drop("run")


def scaled_mean(beats: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Mean of a series' beats, each scaled to 0 to 2 (a flat one is 0), at every position."""
    w = Window.partitionBy("k", "beat")
    low, span = F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w)
    scaled = F.when(span <= eps, F.lit(0.0)).otherwise((F.col("v") - low) / F.nullif(span, F.lit(0.0)) * 2)
    return beats.select("k", "pos", scaled.alias("v")).groupBy("k", "pos").agg(F.avg("v").alias("v"))


def contour(beats: DataFrame) -> DataFrame:
    """Contour features of each beat: times, areas, slopes, and widths at eleven levels of the peak.

    The peak is the first highest sample. A width reaches from the sample nearest to the level before the peak (the first
    of equals) to the nearest after it. Two aggregations share one exchange on (k, beat).
    """
    w = Window.partitionBy("k", "beat")
    n, top = F.count(F.lit(1)).over(w), F.max(F.struct(F.col("v"), -F.col("pos"))).over(w)
    ends = F.min_by("v", "pos").over(w), F.max_by("v", "pos").over(w)
    rows = beats.select("k", "beat", "pos", "v", n.alias("n"), top["v"].alias("top"), (-top["col2"]).alias("at"), ends[0].alias("first"), ends[1].alias("last"))
    before, after = F.col("pos") <= F.col("at"), F.col("pos") >= F.col("at")
    level = lambda p: F.col("top") * (p / 100)
    near = lambda side, p: F.min_by(F.when(side, F.col("pos")), F.when(side, F.struct(F.abs(F.col("v") - level(p)), F.col("pos"))))
    one = lambda c: F.first(c)
    found = rows.groupBy("k", "beat").agg(
        one("n").alias("n"), one("top").alias("top"), one("at").alias("rising"), one("first").alias("first"), one("last").alias("last"),
        F.sum(F.when(before, F.col("v"))).alias("systolic"), F.sum(F.when(after, F.col("v"))).alias("diastolic"),
        *(near(before, p).alias(f"l{p}") for p in LEVELS), *(near(after, p).alias(f"r{p}") for p in LEVELS),
    )
    c = F.col
    rest = F.greatest(c("n") - c("rising"), F.lit(1))
    return found.select(
        "k", "beat", c("rising").alias("t1"), rest.alias("t2"), F.abs(c("rising") - rest).alias("t_sub"), F.try_divide(c("rising"), rest).alias("t_div"), "systolic", "diastolic",
        F.try_divide(c("systolic"), c("diastolic")).alias("area_ratio"), (c("systolic") + c("diastolic")).alias("total"),
        *(F.try_divide(c(x), c("systolic") + c("diastolic")).alias(f"{x}_share") for x in ("systolic", "diastolic")), F.try_divide(c("top") - c("first"), c("rising")).alias("slope_up"), F.try_divide(c("last") - c("top"), c("n") - c("rising")).alias("slope_down"),
        *((c(f"r{p}") - c(f"l{p}")).alias(f"width{p}") for p in LEVELS), *(c(f"{x}{p}").alias(f"{n}{p}") for x, n in (("l", "up"), ("r", "down")) for p in (25, 50, 75)),
    )


def derivative_ratios(points: DataFrame) -> DataFrame:
    """Ratios of the five waves a to e of the second derivative (e may be null): b/a to e/a, ageing index and the rest."""
    c = F.col
    over = lambda x, y: F.try_divide(x, y)
    ageing = F.when(c("e").isNotNull(), over(c("b") - c("c") - c("d") - c("e"), c("a"))).otherwise(over(c("b") - c("c") - c("d"), c("a")))
    return points.select("*", *(over(c(x), c("a")).alias(f"{x}_a") for x in "bcde"), ageing.alias("ageing"), over(c("d") - c("b"), c("a")).alias("wi1"), over(c("c") - c("b"), c("a")).alias("wi2"), over(c("a") - c("b"), c("a") - c("d")).alias("ab_ad"))


def turns(beats: DataFrame) -> DataFrame:
    """k, beat, pos, v, peak of every local maximum (peak) and minimum of each beat: runs of equal samples count at their middle, ends never."""
    w = series(["k", "beat"], "pos")
    new = F.coalesce((F.lag("v").over(w) != F.col("v")).cast("long"), F.lit(0))
    runs = beats.select("k", "beat", "pos", "v", new.alias("new")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = runs.groupBy("k", "beat", "run").agg(F.first("v").alias("v"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    r = series(["k", "beat"], "run")
    before, after = F.lag("v").over(r), F.lead("v").over(r)
    kind = F.when((F.col("v") > before) & (F.col("v") > after), F.lit(True)).when((F.col("v") < before) & (F.col("v") < after), F.lit(False))
    found = flat.withColumn("peak", kind).where("peak is not null")
    return found.select("k", "beat", F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("pos"), "v", "peak")


def check_pulse(beats: DataFrame) -> DataFrame:
    """k, beat, good: at most four turns, a rise no more than two samples longer than the rest, and no second peak above the first. A beat without a peak isn't good."""
    points = turns(beats)
    nth = F.row_number().over(Window.partitionBy("k", "beat", "peak").orderBy("pos"))
    told = points.withColumn("nth", nth).groupBy("k", "beat").agg(
        F.count(F.lit(1)).alias("turns"),
        *(F.max(F.when(F.col("peak") & (F.col("nth") == i), F.col(c))).alias(f"{c}{i}") for c, i in (("pos", 1), ("v", 1), ("v", 2))),
    )
    sizes = beats.groupBy("k", "beat").agg(F.count(F.lit(1)).alias("n"))
    c = F.col
    good = (c("turns") <= 4) & (c("pos1") <= c("n") - c("pos1") + 2) & (c("v2").isNull() | (c("v2") <= c("v1")))
    return sizes.join(told, ["k", "beat"], "left").select("k", "beat", F.coalesce(good, F.lit(False)).alias("good"))


def check_second_derivative(beats: DataFrame, least: float = 0.03) -> DataFrame:
    """k, beat, good for beats of second differences: five turns or more, of the first five the first is highest and the second lowest, and each at least `least` of the length after the one before."""
    points = turns(beats).withColumn("nth", F.row_number().over(series(["k", "beat"], "pos"))).where("nth <= 5")
    gap = (F.col("pos") - F.lag("pos").over(series(["k", "beat"], "pos"))).alias("gap")
    points = points.select("k", "beat", "nth", "v", gap)
    told = points.groupBy("k", "beat").agg(F.count(F.lit(1)).alias("turns"), F.max("v").alias("top"), F.min("v").alias("low"), F.min("gap").alias("gap"), *(F.max(F.when(F.col("nth") == i, F.col("v"))).alias(c) for i, c in ((1, "a"), (2, "b"))))
    sizes = beats.groupBy("k", "beat").agg(F.count(F.lit(1)).alias("n"))
    c = F.col
    good = (c("turns") == 5) & (c("a") == c("top")) & (c("b") == c("low")) & (c("gap") >= least * c("n"))
    return sizes.join(told, ["k", "beat"], "left").select("k", "beat", F.coalesce(good, F.lit(False)).alias("good"))


def second_differences(beats: DataFrame, digits: int = 6) -> DataFrame:
    """The forward differences of second order of each beat, its chord taken off first, rounded so that flat stretches are flat."""
    w = series(["k", "beat"], "pos")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, n = F.first("v").over(ends), F.last("v").over(ends), F.count(F.lit(1)).over(ends)
    flat = beats.select("k", "beat", "pos", (F.col("v") - (first + (last - first) * F.col("pos") / F.greatest(n - 1, F.lit(1)))).alias("v"))
    d = F.lead("v", 2).over(w) - 2 * F.lead("v").over(w) + F.col("v")
    return flat.select("k", "beat", "pos", F.round(d, digits).alias("v")).where("v is not null")


def accepted(beats: DataFrame) -> DataFrame:
    """k, beat of the beats that both checks pass and whose statistics are usual."""
    good = check_pulse(beats).where("good").join(check_second_derivative(second_differences(beats)).where("good"), ["k", "beat"], "left_semi")
    return good.select("k", "beat").join(usual(statistics(beats)), ["k", "beat"], "left_semi")


def representative(beats: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """k, pos, v: the mean of each series' chosen beats (k, beat), each over its highest sample and on `size` points of its spline, less the chord, scaled 0 to 2."""
    own = beats.join(chosen, ["k", "beat"], "left_semi")
    top = F.max("v").over(Window.partitionBy("k", "beat"))
    even = upsampled(own.select("k", "beat", "pos", F.try_divide("v", top).alias("v")), size, ("k", "beat"), "pos")
    mean = even.groupBy("k", "i").agg(F.avg("v").alias("v"))
    w = series("k", "i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flat = mean.select("k", "i", (F.col("v") - (F.first("v").over(w) + (F.last("v").over(w) - F.first("v").over(w)) * F.col("i") / max(size - 1, 1))).alias("v"))
    whole = Window.partitionBy("k")
    low, span = F.min("v").over(whole), F.max("v").over(whole) - F.min("v").over(whole)
    return flat.select("k", F.col("i").alias("pos"), F.when(span <= 1e-8, F.lit(0.0)).otherwise((F.col("v") - low) / F.nullif(span, F.lit(0.0)) * 2).alias("v"))


WAVES = ["a_at", "b_at", "c_at", "d_at", "e_at", "a", "b", "c", "d", "e", "b_a", "c_a", "d_a", "e_a", "ageing", "wi1", "wi2", "ab_ad", "area_bd", "v_top", "r_slope", "c_slope", "e_found"]


def wide_peaks(v: np.ndarray, distance: int = 5, width: float = 5.0) -> np.ndarray:
    """Places of local maxima that are `distance` apart (the highest stay) and `width` wide at half of their prominence."""
    new = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, int)
    last = np.append(new[1:], len(v)) - 1
    level = v[new]
    inner = np.arange(1, len(new) - 1)
    inner = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])] if len(inner) else inner
    at = (new[inner] + last[inner]) // 2
    keep = np.ones(len(at), bool)
    for i in np.argsort(v[at], kind="stable")[::-1]:
        if keep[i]:
            near = (np.abs(at - at[i]) < distance) & (np.arange(len(at)) != i)
            keep[near] = False
    out = []
    for p in at[keep]:
        left, right = np.flatnonzero(v[:p] > v[p]), np.flatnonzero(v[p + 1 :] > v[p])
        i, j = (left[-1] + 1 if len(left) else 0), (p + right[0] if len(right) else len(v) - 1)
        height = v[p] - 0.5 * (v[p] - max(v[i : p + 1].min(), v[p : j + 1].min()))
        a, b = p, p
        while a > i and v[a] > height:
            a -= 1
        while b < j and v[b] > height:
            b += 1
        start = a + (height - v[a]) / (v[a + 1] - v[a]) if v[a] < height else float(a)
        stop = b - (height - v[b]) / (v[b - 1] - v[b]) if v[b] < height else float(b)
        if stop - start >= width:
            out.append(p)
    return np.asarray(out, int)


def derivative_waves(y: np.ndarray, rate: float) -> list[float] | None:
    """The 23 features of a pulse's derivatives (WAVES); None if the second one has fewer than four wide turns, or the third fewer than two peaks."""
    return waves_of(y[None], rate)[0]


def waves_of(y: np.ndarray, rate: float) -> list[list[float] | None]:
    """derivative_waves of the rows of a matrix: derivatives, band-pass and peaks of the third one are taken of all rows at once."""
    one = np.diff(y, axis=1)
    two = np.diff(one, axis=1)
    three = np.diff(two, axis=1)
    three = bandpass(0.4, 12.0, rate).rows(three, np.full(len(three), three.shape[1]))
    reach = max(int(rate / 20), 1)
    padded = np.pad(three, ((0, 0), (reach, reach)), constant_values=-np.inf)
    beside = np.lib.stride_tricks.sliding_window_view(padded, reach, axis=1).max(-1)  # NaN where there is one
    is_top = (three > beside[:, : three.shape[1]]) & (three > beside[:, reach + 1 :])
    is_top[:, :1] = is_top[:, -1:] = False
    return [_waves(*parts) for parts in zip(one, two, is_top, strict=True)]


def _waves(one: np.ndarray, two: np.ndarray, is_top: np.ndarray) -> list[float] | None:
    at = np.sort(np.concatenate([wide_peaks(two), wide_peaks(-two)]))
    tops = np.flatnonzero(is_top)
    if len(at) < 4 or len(tops) < 2:
        return None
    a, b, c, d = two[at[:4]]
    found = len(at) > 4
    e = two[at[4]] if found else np.nan
    r = tops[1] if 40 <= tops[1] <= 60 else 50
    over = lambda x, z: float(x / z) if z else np.nan
    top = one.max()
    return [*map(float, at[:4]), float(at[4]) if found else -1.0, a, b, c, d, e, over(b, a), over(c, a), over(d, a), over(e, a), over(b - c - d - (e if found else 0), a), over(d - b, a), over(c - b, a), over(a - b, a - d), float(two[at[1] : at[3] + 1].sum()), top, float(one[r]) if r < len(one) else np.nan, over(one[at[2]], top), float(found)]


def derivative_features(beats: DataFrame, size: int, keys: tuple[str, ...] = ("k", "beat")) -> DataFrame:
    """The features of WAVES for each beat, on `size` points of its spline; no row for a beat without them."""
    rows = packed(beats, keys, "pos").drop("t")
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c in keys)

    def run(batches):
        for part, v, n in matrices(batches):
            found = waves_of(to_length(v, n, size), float(size))
            keep = [i for i, x in enumerate(found) if x is not None]
            take = pa.array(keep, pa.int64())
            columns = np.asarray([found[i] for i in keep], float).reshape(-1, len(WAVES)).T
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in keys), *(pa.array(x, mask=~np.isfinite(x)) for x in columns)], [*keys, *WAVES])

    return rows.mapInArrow(run, f"{kinds}, {', '.join(f'{c} double' for c in WAVES)}")


def mean_features(features: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of every numeric feature over the beats of each key; nulls don't count."""
    names = [c for c, kind in features.dtypes if c not in (*keys, "beat") and kind in ("double", "bigint", "int")]
    return features.groupBy(*keys).agg(F.count(F.lit(1)).alias("beats"), *(F.avg(c).alias(c) for c in names))
