"""Operators on signals in long form, rows (k, t, v): scaling, resampling, aligning, windows, peaks, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.windows import difference, filled, gradient, is_extreme, minmax, series, whole, zscore


def reversed_signal(x: DataFrame) -> DataFrame:
    """Turned upside down, its lowest value 0."""
    return x.select("k", "t", (F.max("v").over(whole("k")) - F.col("v")).alias("v"))


def differences(x: DataFrame, times: int = 4) -> DataFrame:
    """Forward differences of order 1 to `times`, each null where the series has no later samples."""
    w = series("k", "t")
    for i in range(1, times + 1):
        x = x.withColumn(f"d{i}", difference("v" if i == 1 else f"d{i - 1}", w))
    return x


def gradients(x: DataFrame) -> DataFrame:
    w = series("k", "t")
    return x.withColumn("g1", gradient("v", w)).withColumn("g2", gradient("g1", w))


def without_outliers(x: DataFrame, fence: float = 3.0) -> DataFrame:
    """Values outside of the quartiles by more than `fence` interquartile ranges become null."""
    quarter = x.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    inside = F.col("v").between(low - fence * (high - low), high + fence * (high - low))
    return x.join(quarter, "k").select("k", "t", F.when(inside, F.col("v")).alias("v"), (~inside).alias("outlier"))


def outliers_filled(x: DataFrame, fence: float = 3.0, n: int = 4) -> DataFrame:
    """Outliers by without_outliers put on the line between their neighbours, at the ends the mean of n samples beside the first (last) good one."""
    told = without_outliers(x, fence)
    return edges_filled(told.select("k", "t", "v"), n)


def without_chord(x: DataFrame) -> DataFrame:
    """Less the line from the first to the last sample."""
    w = series("k", "t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, n = F.first("v").over(w), F.last("v").over(w), F.count(F.lit(1)).over(w)
    step = (F.row_number().over(series("k", "t")) - 1) / F.greatest(n - 1, F.lit(1))
    return x.select("k", "t", (F.col("v") - (first + (last - first) * step)).alias("v"))


def resampled(x: DataFrame, n: int) -> DataFrame:
    """n samples of each series on the line between its own, evenly spaced from its first to its last (t from 1 without gaps)."""
    ends = x.groupBy("k").agg(F.max("t").alias("n"))
    grid = ends.select("k", "n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    grid = grid.select("k", F.col("i").cast("long").alias("i"), ((F.col("n") - 1) * F.col("i") / float(max(n - 1, 1))).alias("x")).withColumn("t", F.floor("x") + 1)
    own = x.select("k", "t", "v", F.lead("v").over(series("k", "t")).alias("next"))
    return grid.join(own, ["k", "t"]).select("k", "i", (F.col("v") + (F.coalesce("next", "v") - F.col("v")) * (F.col("x") - F.floor("x"))).alias("v"))


def time_slice(x: DataFrame, start: float, length: float, rate: float) -> DataFrame:
    """Samples from second `start` on, for `length` seconds at `rate` a second; t counts from 1."""
    return x.where(F.col("t").between(int(start * rate) + 1, int((start + length) * rate)))


def first_of_time(x: DataFrame, time: str, order: list[str]) -> DataFrame:
    """Of the samples with one time, the first by `order`."""
    w = Window.partitionBy("k", time).orderBy(*order)
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def aligned_forward(left: DataFrame, right: DataFrame, time: str = "sec", value: str = "v") -> DataFrame:
    """left (k, time) with the first value of right (k, time, value) at that time or later, else right's last: one sort, no range join."""
    rows = left.select("k", time, F.lit(None).cast("double").alias("v"), F.lit(0).alias("side")).unionByName(right.select("k", time, F.col(value).alias("v"), F.lit(1).alias("side")))
    w = Window.partitionBy("k").orderBy(time, "side")
    ahead = F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    final = F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("k", time, "side", F.coalesce(ahead, final).alias("v")).where("side = 0").drop("side")


def extrema(x: DataFrame, reach: int) -> DataFrame:
    w = series("k", "t")
    return x.select("*", is_extreme("v", w, reach).alias("peak"), is_extreme("v", w, reach, low=True).alias("valley"))


def intervals(x: DataFrame, rate: float, reach: int) -> DataFrame:
    """Time between valleys in seconds; implausible ones (outside of 0.33 to 1.5 s) are null."""
    valleys = extrema(x, reach).where("valley")
    gap = difference("t", series("k", "t")) / rate
    return valleys.select("k", "t", gap.alias("gap")).select("k", "t", F.when(F.col("gap").between(0.33, 1.5), F.col("gap")).alias("ibi"))


def heart_rate(x: DataFrame, rate: float, reach: int) -> DataFrame:
    return intervals(x, rate, reach).groupBy("k").agg(F.count("ibi").alias("n"), (60 / F.avg("ibi")).alias("bpm"))


def spectrum(x: DataFrame, bins: int) -> DataFrame:
    """Squared magnitude of the first `bins` frequencies (from 1), as sums over (series, bin): for short series."""
    ends = x.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    angle = 2 * F.pi() * F.col("bin") * (F.col("t") - 1) / F.col("n")
    waves = x.join(ends, "k").select("k", "n", (F.col("v") - F.col("mean")).alias("v"), "t", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    sums = waves.groupBy("k", "bin").agg(F.max("n").alias("n"), F.sum(F.col("v") * F.cos(angle)).alias("c"), F.sum(F.col("v") * F.sin(angle)).alias("s"))
    return sums.select("k", F.col("bin").cast("long").alias("bin"), "n", (F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("power"))


def windowed(x: DataFrame, length: int, hop: int, columns: tuple[str, ...] = ("v",), eps: float = 1e-8) -> DataFrame:
    """Full windows of `length` samples every `hop`, their columns z-scored (population deviation) within each: win from 0."""
    ends = F.max("t").over(whole("k"))
    at = F.col("t") - 1
    if length == hop:
        starts = x.withColumn("win", F.floor(at / hop)).withColumn("_n", ends)
    else:
        low = F.greatest(F.floor((at - length) / hop) + 1, F.lit(0))
        starts = x.withColumn("_n", ends).withColumn("win", F.explode(F.sequence(low, F.floor(at / hop))))
    w = Window.partitionBy("k", "win")
    full = starts.where(F.col("win") * hop + length <= F.col("_n")).drop("_n")
    scaled = [((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + eps)).alias(c) for c in columns]
    return full.select("k", F.col("win").cast("long").alias("win"), (at - F.col("win") * hop).cast("long").alias("pos"), *scaled)


def destandardised(x: DataFrame, value: str, mean: str, sd: str, eps: float = 1e-8) -> DataFrame:
    return x.withColumn(value, F.col(value) * (F.col(sd) + eps) + F.col(mean))


def peaks(x: DataFrame, low: bool = False) -> DataFrame:
    """k, t, v of every local maximum (minimum): a run of equal samples above both neighbours, at its middle; ends never count."""
    w = series("k", "t")
    sign = -1 if low else 1
    new = F.coalesce((F.lag("v").over(w) != F.col("v")).cast("long"), F.lit(0))
    runs = x.select("k", "t", "v", new.alias("new"))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = runs.groupBy("k", "run").agg(F.first("v").alias("v"), F.min("t").alias("a"), F.max("t").alias("b"))
    r = series("k", "run")
    above = (sign * F.col("v") > sign * F.lag("v").over(r)) & (sign * F.col("v") > sign * F.lead("v").over(r))
    return flat.withColumn("is", F.coalesce(above, F.lit(False))).where("is").select("k", F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("t"), "v")


def extrema_without_first(x: DataFrame, reach: int, n: int = 2) -> DataFrame:
    """Peaks and valleys, each kind without a series' first n: kind, nth (from 1), t, v."""
    found = extrema(x, reach).where("peak or valley").select("k", "t", "v", F.when(F.col("peak"), "peak").otherwise("valley").alias("kind"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("k", "kind").orderBy("t")).cast("long")).where(F.col("nth") > n)


def at_rate(x: DataFrame, time: str, rate: float) -> DataFrame:
    """Samples every 1 / rate from time 0 to before the last, on the line between a series' own: k, i, v; one sort, no range join."""
    ends = x.groupBy("k").agg(F.max(time).alias("_end"))
    grid = ends.select("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_end") * rate).cast("int"))).alias("i"), "_end").withColumn("at", F.col("i") / rate).where("at < _end")
    rows = x.select("k", F.col(time).alias("at"), "v", F.lit(None).cast("int").alias("i")).unionByName(grid.select("k", "at", F.lit(None).cast("double").alias("v"), "i"))
    w = Window.partitionBy("k").orderBy("at", F.col("i").isNotNull())
    here = F.when(F.col("i").isNull(), F.struct("at", "v"))
    back, ahead = F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    placed = rows.select("k", "i", "at", back.alias("p"), ahead.alias("q")).where("i is not null")
    between = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("at") - F.col("p.at")) / F.nullif(F.col("q.at") - F.col("p.at"), F.lit(0.0))
    return placed.select("k", F.col("i").cast("long").alias("i"), F.coalesce(between, F.col("p.v"), F.col("q.v")).alias("v"))


def full_spectrum(x: DataFrame) -> DataFrame:
    """Magnitude of every frequency below half the rate: k, bin (from 0), n, size. Sums over (series, bin), for series of some hundred samples."""
    ends = x.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    angle = 2 * F.pi() * ((F.col("bin") * (F.col("t") - 1)) % F.col("n")) / F.col("n")
    waves = x.join(ends, "k").select("k", "n", "v", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 2) - 1)).alias("bin"))
    sums = waves.groupBy("k", "bin").agg(F.max("n").alias("n"), F.sum(F.col("v") * F.cos(angle)).alias("c"), F.sum(F.col("v") * F.sin(angle)).alias("s"))
    return sums.select("k", "bin", "n", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("size"))


def heart_rate_by_spectrum(x: DataFrame, rate: float, low: float = 0.7, high: float = 4.0, least: int = 64) -> DataFrame:
    """60 times the strongest frequency from low to high hertz (the lowest of equals); null for series under `least` samples."""
    band = full_spectrum(x).withColumn("f", F.col("bin") * rate / F.col("n"))
    best = F.max_by(F.when(F.col("f").between(low, high), F.col("f")), F.when(F.col("f").between(low, high), F.struct(F.round("size", 6).alias("s"), -F.col("bin"))))
    return band.groupBy("k").agg(F.when(F.max("n") >= least, 60 * best).alias("bpm"))


def signal_to_noise(x: DataFrame, rate: float, reach: float = 0.3) -> DataFrame:
    """Decibels of the magnitudes within `reach` hertz of the fundamental and its next two multiples over all others.

    The fundamental is the lower of the two strongest frequencies. Null where a band leaves the spectrum.
    """
    s = full_spectrum(x)
    order = Window.partitionBy("k").orderBy(F.desc(F.round("size", 6)), "bin")
    top = s.withColumn("_r", F.row_number().over(order)).where("_r <= 2").groupBy("k").agg(F.min("bin").alias("peak"), F.max("n").alias("n"))
    top = top.withColumn("reach", F.floor(reach * F.col("n") / rate))
    d = lambda m: (F.abs(F.col("bin") - m * F.col("peak")) <= F.col("reach")).cast("int")
    sums = s.drop("n").join(top, "k").groupBy("k").agg(F.sum(F.col("size") * (d(1) + d(2) + d(3))).alias("signal"), F.sum("size").alias("total"), F.max("bin").alias("last"), F.max("peak").alias("peak"), F.max("reach").alias("reach"))
    whole_bands = (F.col("peak") >= F.col("reach")) & (3 * F.col("peak") + F.col("reach") <= F.col("last"))
    ratio = F.try_divide(F.col("signal"), F.col("total") - F.col("signal"))
    return sums.select("k", F.col("peak").alias("bin"), F.when(whole_bands & (ratio > 0), 10 * F.log10(ratio)).alias("snr"))


def edges_filled(x: DataFrame, n: int = 4) -> DataFrame:
    """Gaps inside a series on the line between their neighbours; at its ends the mean of the n samples after the first good one (before the last)."""
    w = series("k", "t")
    good = F.col("v").isNotNull()
    place = x.withColumn("first", F.min(F.when(good, F.col("t"))).over(whole("k"))).withColumn("last", F.max(F.when(good, F.col("t"))).over(whole("k")))
    head = F.avg(F.when((F.col("t") > F.col("first")) & (F.col("t") <= F.col("first") + n), F.col("v"))).over(whole("k"))
    tail = F.avg(F.when((F.col("t") < F.col("last")) & (F.col("t") >= F.col("last") - n), F.col("v"))).over(whole("k"))
    return place.select("k", "t", F.when(F.col("t") < F.col("first"), head).when(F.col("t") > F.col("last"), tail).otherwise(filled("v", "t", w, None)).alias("v"))


def straight_fit(x: DataFrame) -> DataFrame:
    """The least-squares line of each series over its samples' places."""
    w = whole("k")
    slope = F.try_divide(F.covar_pop("t", "v").over(w), F.var_pop("t").over(w))
    return x.select("k", "t", (F.avg("v").over(w) + slope * (F.col("t") - F.avg("t").over(w))).alias("v"))


def normalised(x: DataFrame, how: str) -> DataFrame:
    """none, minmax or zscore of each series."""
    v = {"none": lambda: F.col("v"), "minmax": lambda: minmax("v", whole("k")), "zscore": lambda: zscore("v", whole("k"))}[how]()
    return x.select("k", "t", v.alias("v"))
