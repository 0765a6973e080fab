"""Tables of a study: the beats of each signal with their quality and acceptance, features of each good beat, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.windows import gradient, series
from tidewave.operators.beats import THRESHOLDS, WAVES, alike, check_pulse, contour, cut, cut_with_margin, derivative_features, margin_statistics, mean_features, near_mean, scaled_mean, turns, usual, whole_beats, without_margin_chord
from tidewave.operators.filters import apply_chain, bandpass, by_envelope
from tidewave.operators.waves import upsampled

_BEAT = ("k", "beat")


def normal_wave(x: DataFrame, rate: float) -> DataFrame:
    """A signal in the band of 0.4 to 10 Hz over its envelope."""
    return apply_chain(x, [bandpass(0.4, 10.0, rate, 5), by_envelope()])


def segments(x: DataFrame, rate: float, reach: int, points: int = 50, mode: str = "non-conservative") -> DataFrame:
    """Beats from valley to valley: k, beat, start, end (seconds), n (samples), sqi_wave, sqi, quality, accepted_ppg, accepted_area.

    sqi_wave and sqi are how alike a beat is to the next one, by itself and by its second derivative, on `points` points of
    their splines; quality asks the threshold of both. Beats under three samples have no index, nor has the one before.
    accepted_ppg: the beat less its chord has the form of a pulse; accepted_area: area, duration and height are usual.
    """
    form = check_pulse(without_margin_chord(cut(x, reach), 0)).withColumnRenamed("good", "accepted_ppg")
    return marked_beats(x, rate, reach, points, mode).join(form, list(_BEAT), "left").select(*_BEAT, "start", "end", "n", "sqi_wave", "sqi", "quality", "accepted_ppg", "accepted_area")


def marked_beats(x: DataFrame, rate: float, reach: int, points: int = 50, mode: str = "non-conservative") -> DataFrame:
    """`segments` without accepted_ppg, and v, the beat's samples: each beat is one row from its cut on, so that its table needs no join."""
    rows = whole_beats(cut(x, reach)).withColumnRenamed("n", "duration")
    told = alike(rows.withColumn("accepted_area", F.coalesce(near_mean(), F.lit(False))), points, {"sqi_wave": 0, "sqi": 2}, 3)
    least = THRESHOLDS[mode]
    good = F.coalesce((F.col("sqi_wave") >= least) & (F.col("sqi") >= least), F.lit(False))
    return told.select(*_BEAT, ((F.col("first") - 1) / rate).alias("start"), (F.col("last") / rate).alias("end"), F.col("duration").alias("n"), "sqi_wave", "sqi", good.alias("quality"), "accepted_area", "v")


def resized(beats: DataFrame, size: int) -> DataFrame:
    """Beats as `size` samples on the lines between their own, evenly spaced from the first to the last: every sample gives out those that follow it, so there is no join. Beats of one sample are left out."""
    w = series(list(_BEAT), "pos")
    rows = beats.select(*_BEAT, "pos", "v", F.lead("v").over(w).alias("next"), F.count("*").over(Window.partitionBy(*_BEAT)).alias("n")).where("n > 1")
    first = F.expr(f"(pos * {size - 1} + n - 2) div (n - 1)")
    last = F.expr(f"case when next is null then {size - 1} else ((pos + 1) * {size - 1} + n - 2) div (n - 1) - 1 end")
    out = rows.withColumn("lo", first).withColumn("hi", last).where("lo <= hi").select("*", F.explode(F.sequence("lo", "hi")).alias("i"))
    part = F.col("i") * (F.col("n") - 1) / float(max(size - 1, 1)) - F.col("pos")
    return out.select(*_BEAT, F.col("i").cast("long").alias("pos"), (F.col("v") + (F.coalesce("next", "v") - F.col("v")) * part).alias("v"))


def from_first_valley(beats: DataFrame) -> DataFrame:
    """Beats less, from their first inner valley on, the line from there to the end, moved to where the valley was; a beat without one stays."""
    valley = turns(beats).where("not peak").groupBy(*_BEAT).agg(F.min("pos").alias("at"))
    every = Window.partitionBy(*_BEAT)
    rows = beats.join(valley, list(_BEAT), "left").select(*_BEAT, "pos", "v", "at", F.max(F.when(F.col("pos") == F.col("at"), F.col("v"))).over(every).alias("from"), F.max_by("v", "pos").over(every).alias("to"), F.max("pos").over(every).alias("n"))
    line = F.col("from") + (F.col("to") - F.col("from")) * (F.col("pos") - F.col("at")) / F.greatest(F.col("n") - F.col("at"), F.lit(1))
    return rows.select(*_BEAT, "pos", F.when(F.col("pos") >= F.col("at"), F.col("v") - line + F.col("from")).otherwise(F.col("v")).alias("v"))


def beat_contours(x: DataFrame, chosen: DataFrame, reach: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The chosen beats (k, beat, n) of five samples or more on `size` points less their chord, and the contour features of each, named cn_*.

    Beats of `marked_beats` bring their samples; those of `segments` are cut from x again.
    """
    chosen = chosen.where("n >= 5")
    if "v" in chosen.columns:
        dealt = chosen.select(*_BEAT, "v").repartition(*_BEAT)  # once for all that follows
        cuts = dealt.select(*_BEAT, F.posexplode("v").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))
    else:
        cuts = cut(x, reach).join(chosen.select(*_BEAT), list(_BEAT), "left_semi")
    flat = without_margin_chord(resized(cuts, size), 0)
    told = contour(flat)
    return flat, told.select(*_BEAT, *(F.col(c).alias(f"cn_{c}") for c in told.columns if c not in _BEAT))


def beat_features(x: DataFrame, chosen: DataFrame, reach: int, size: int) -> DataFrame:
    """k, beat, start, end, cn_* and dr_* of the chosen beats of `segments` or `marked_beats`; beats whose second derivative lacks waves are left out."""
    return chosen.select(*_BEAT, "start", "end").join(_features(x, chosen, reach, size), list(_BEAT))


def _features(x: DataFrame, chosen: DataFrame, reach: int, size: int) -> DataFrame:
    flat, told = beat_contours(x, chosen, reach, size)
    w = series(list(_BEAT), "pos")
    twice = flat.select(*_BEAT, "pos", gradient("v", w).alias("v")).select(*_BEAT, "pos", gradient("v", w).alias("v"))
    waves = derivative_features(from_first_valley(twice), size)
    waves = waves.select(*_BEAT, *(F.col(c).alias(f"dr_{c}") for c in WAVES))
    return told.join(waves, list(_BEAT))


def study_features(x: DataFrame, rate: float, reach: int, size: int = 200, mode: str = "non-conservative", points: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of a study: mean features of each signal, features of each good beat, and all segments."""
    chosen = marked_beats(x, rate, reach, points, mode).where("quality")
    return mean_features(_features(x, chosen, reach, size), ["k"]), beat_features(x, chosen, reach, size), segments(x, rate, reach, points, mode)


def accepted_with_margin(x: DataFrame, reach: int, margin: int) -> DataFrame:
    """k, beat of the beats that have the form of a pulse, are usual in area, duration and height, and whose second differences, margin included, have the order of waves a to e."""
    cuts = cut_with_margin(x, reach, margin)
    stats = margin_statistics(cuts, margin)
    form = check_pulse(without_margin_chord(cuts.where(F.col("pos") >= margin).withColumn("pos", F.col("pos") - margin), 0)).where("good")
    return usual(stats).where("good").select(*_BEAT).join(form.select(*_BEAT), list(_BEAT), "left_semi")


def mean_shape(x: DataFrame, chosen: DataFrame, reach: int, margin: int, size: int) -> DataFrame:
    """k, beat (1), pos, v: the mean of each series' chosen beats, margin included, each on `size` points of its spline and scaled 0 to 2."""
    own = cut_with_margin(x, reach, margin).join(chosen, list(_BEAT), "left_semi")
    even = upsampled(own, size, _BEAT, "pos").withColumnRenamed("i", "pos")
    return scaled_mean(even).select("k", F.lit(1).cast("long").alias("beat"), "pos", "v")


def representative_contours(x: DataFrame, chosen: DataFrame, reach: int, size: int) -> DataFrame:
    """k and cn_*: contour features of each series' mean shape less its chord, scaled 0 to 2."""
    flat = scaled_mean(without_margin_chord(mean_shape(x, chosen, reach, 0, size), 0))
    told = contour(flat.select("k", F.lit(1).cast("long").alias("beat"), "pos", "v"))
    return told.select("k", *(F.col(c).alias(f"cn_{c}") for c in told.columns if c not in _BEAT))


def representative_features(x: DataFrame, chosen: DataFrame, reach: int, margin: int, size: int) -> DataFrame:
    """k, beats (chosen), cn_* of the mean shape and dr_* of the mean shape with its margin, corrected from its first valley on; series whose second derivative lacks waves are left out."""
    chosen = chosen.select(*_BEAT).repartition(*_BEAT)  # found once for all that follows
    waves = derivative_features(from_first_valley(mean_shape(x, chosen, reach, margin, size)), size)
    counts = chosen.groupBy("k").agg(F.count("*").alias("beats"))
    told = representative_contours(x, chosen, reach, size)
    return counts.join(told, "k").join(waves.select("k", *(F.col(c).alias(f"dr_{c}") for c in WAVES)), "k")
