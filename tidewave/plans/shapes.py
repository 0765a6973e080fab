"""More registered queries: resampling, envelopes, further colour methods, beat checks and features; DuckDB SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewave.operators import beats, colour, filters, signal, waves
from tidewave.plans.catalogue import _HB, _HG, _HR, ALL, BT, EV, R6, RGB, _values, query, r6
from tidewave.sources.tables import colour_traces, cut_beats, event_signals, table

# resampling


def _sampled(df):
    return df.select("k", "i", r6("v").alias("v"))


@query()
def sig_upsample_cubic(spark, d):
    return _sampled(waves.upsampled(event_signals(spark, d), 120))


_TAPS = ", ".join(f"{t!r}::DOUBLE" for t in map(float, waves.kaiser_taps(3, 10)))


@query(f"""WITH {EV}, n AS (SELECT k, max(t) AS n FROM ev GROUP BY k), g AS (SELECT k, i FROM n, range(0, 100000) r(i) WHERE i < ceil(n * 3 / 10.0::DOUBLE)), h AS (SELECT generate_subscripts([{_TAPS}], 1) - 1 AS p, unnest([{_TAPS}]) AS h)
SELECT g.k, i, {R6('coalesce(sum(v * h), 0)')} AS v FROM g JOIN ev ON g.k = ev.k AND (t - 1) * 3 BETWEEN i * 10 - 100 AND i * 10 + 100 JOIN h ON p = i * 10 - (t - 1) * 3 + 100 GROUP BY g.k, i""")
def sig_resample_poly(spark, d):
    return _sampled(waves.resampled(event_signals(spark, d), 3, 10))


@query()
def sig_second_differences(spark, d):
    return waves.second_differences(cut_beats(spark, d), 100, 5, ("k", "beat"), "pos").select("k", "beat", "i", r6("v", 3).alias("v"))


@query()
def sig_normal_pulse(spark, d):
    return waves.normal_pulses(cut_beats(spark, d), 100, True, ("k", "beat"), "pos").select("k", "beat", "i", r6("v").alias("v"), "peak", "usable")


@query()
def sig_envelopes(spark, d):
    return waves.enveloped(event_signals(spark, d), 6.0).select("k", "i", r6("upper").alias("upper"), r6("lower").alias("lower"))


@query()
def sig_interval_spectrum(spark, d):
    return _sampled(waves.interval_spectrum(signal.intervals(event_signals(spark, d), 6.0, 2)))


@query()
def sig_at_times(spark, d):
    x = event_signals(spark, d).select("k", ((F.col("t") + F.col("t") % 3) / 6.0).alias("sec"), "v")
    return _sampled(waves.at_times(x, "sec", 4.0))


@query()
def filt_lowpass(spark, d):
    return _values(filters.apply_chain(colour.chrom(colour_traces(spark, d)), [filters.lowpass(5.0, 30.0)]))


@query()
def filt_bandpass3(spark, d):
    return _values(filters.apply_chain(colour.chrom(colour_traces(spark, d)), [filters.bandpass(0.7, 3.0, 30.0, 3)]))


@query()
def filt_bandpass5(spark, d):
    return filters.apply_chain(colour.chrom(colour_traces(spark, d)), [filters.bandpass(0.4, 10.0, 30.0, 5)]).select("k", "t", r6("v", 4).alias("v"))


@query()
def ppg_preprocess(spark, d):
    """A reference signal at 3 / 10 of its rate, detrended, band-passed and turned over."""
    x = waves.resampled(colour.green(colour_traces(spark, d)), 3, 10).withColumnRenamed("i", "t")
    return _values(filters.apply_chain(x, [filters.detrend(30.0), filters.bandpass(0.1, 12.0, 30.0)]).withColumn("v", -F.col("v")))


# colour


@query()
def pulse_ica(spark, d):
    return colour.ica(colour_traces(spark, d)).select("k", "t", r6("v", 4).alias("v"))


@query()
def pulse_pca_both(spark, d):
    return _values(colour.pca_both(colour_traces(spark, d)))


_SKIN = f"""top AS (SELECT CASE WHEN max(greatest(r, g, b)) > 1.5 THEN 255.0 ELSE 1.0 END AS s FROM rgb), y AS (SELECT k, t, -ln(least(greatest(r / s, 1e-8), 1.0)) AS r, -ln(least(greatest(g / s, 1e-8), 1.0)) AS g, -ln(least(greatest(b / s, 1e-8), 1.0)) AS b FROM rgb, top),
 nrm AS (SELECT 0.3570 * 0.6657 - 0.8372 * 0.6838 AS x, 0.8372 * 0.2988 - 0.4143 * 0.6657 AS y, 0.4143 * 0.6838 - 0.3570 * 0.2988 AS z),
 l AS (SELECT k, t, r, g, b, (CAST(nrm.x AS DOUBLE) * r + CAST(nrm.y AS DOUBLE) * g + CAST(nrm.z AS DOUBLE) * b) / (CAST(nrm.x + nrm.y + nrm.z AS DOUBLE) + 1e-8) AS light FROM y, nrm)"""


@query(f"WITH {RGB}, {_SKIN} SELECT k, t, {R6('r - light')} AS r, {R6('g - light')} AS g, {R6('b - light')} AS b, {R6(f'CAST({_HR} AS DOUBLE) * r + CAST({_HG} AS DOUBLE) * g + CAST({_HB} AS DOUBLE) * b')} AS hemo FROM l")
def pulse_skin_flat(spark, d):
    return colour.skin_flat(colour_traces(spark, d)).select("k", "t", *(r6(c).alias(c) for c in ("r", "g", "b", "hemo")))


@query()
def pulse_lgi_global(spark, d):
    return _values(colour.lgi_global(colour.to_shortest(colour_traces(spark, d))))


@query()
def pulse_robust(spark, d):
    return _values(colour.robust(colour.to_shortest(colour_traces(spark, d)), 30.0))


_PIXELS = "px AS (SELECT l_suppkey AS frame, l_partkey % 20 AS x, l_orderkey % 16 AS y, l_quantity AS r, l_extendedprice / 1000 AS g, 100 * l_discount AS b FROM lineitem)"
_BOXES = [("forehead", 2, 9, 0, 5), ("cheek", 10, 15, 6, 12), ("outside", 30, 40, 0, 5)]


def _pixels(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 20).alias("x"), (F.col("l_orderkey") % 16).alias("y"), F.col("l_quantity").alias("r"), (F.col("l_extendedprice") / 1000).alias("g"), (100 * F.col("l_discount")).alias("b"))


@query(f"""WITH {_PIXELS}, bx(roi, x0, x1, y0, y1) AS (VALUES {', '.join(map(str, _BOXES))}) SELECT frame, roi, {', '.join(f"{R6(f'avg({c}) FILTER (WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1)')} AS {c}" for c in 'rgb')} FROM px, bx GROUP BY frame, roi""")
def roi_box_means(spark, d):
    return colour.box_means(_pixels(spark, d), _BOXES).select("frame", "roi", *(r6(c).alias(c) for c in "rgb"))


@query(f"WITH {_PIXELS} SELECT frame, roi, {R6('avg((299 * r + 587 * g + 114 * b) / 1000)')} AS grey FROM px JOIN (SELECT n_name AS roi, n_nationkey % 20 AS x, n_regionkey AS y FROM nation) USING (x, y) GROUP BY frame, roi")
def roi_mask_grey(spark, d):
    mask = table(spark, d, "nation").select(F.col("n_name").alias("roi"), (F.col("n_nationkey") % 20).alias("x"), F.col("n_regionkey").alias("y"))
    grey = _pixels(spark, d).withColumn("grey", (299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")) / 1000)
    return colour.mask_means(grey, mask, ("grey",)).select("frame", "roi", r6("grey").alias("grey"))


# beats: few samples, so that some pass

_EASY = "eb AS (SELECT k, beat, pos // 6 AS pos, floor(round(avg(v) * 10, 9)) / 10 AS v FROM bt GROUP BY k, beat, pos // 6)"
_TURNS = """rn AS (SELECT *, coalesce(CAST(lag(v) OVER w <> v AS BIGINT), 0) AS new FROM {0} WINDOW w AS (PARTITION BY k, beat ORDER BY pos)), ru AS (SELECT *, sum(new) OVER (PARTITION BY k, beat ORDER BY pos) AS run FROM rn),
 fl AS (SELECT k, beat, run, first(v) AS v, (min(pos) + max(pos)) // 2 AS pos FROM ru GROUP BY k, beat, run), nb AS (SELECT *, lag(v) OVER (PARTITION BY k, beat ORDER BY run) AS p, lead(v) OVER (PARTITION BY k, beat ORDER BY run) AS q FROM fl),
 tn AS (SELECT k, beat, pos, v, v > p AS peak FROM nb WHERE (v > p AND v > q) OR (v < p AND v < q)), sz AS (SELECT k, beat, count(*) AS n FROM {0} GROUP BY k, beat)"""
_CHECK1 = """po AS (SELECT *, row_number() OVER (PARTITION BY k, beat, peak ORDER BY pos) AS nth FROM tn), tl AS (SELECT k, beat, count(*) AS turns, max(pos) FILTER (WHERE peak AND nth = 1) AS p1, max(v) FILTER (WHERE peak AND nth = 1) AS v1, max(v) FILTER (WHERE peak AND nth = 2) AS v2 FROM po GROUP BY k, beat),
 ok1 AS (SELECT sz.k, sz.beat, coalesce(turns <= 4 AND p1 <= n - p1 + 2 AND (v2 IS NULL OR v2 <= v1), false) AS good FROM sz LEFT JOIN tl ON sz.k = tl.k AND sz.beat = tl.beat)"""
_SECOND = "sd AS (SELECT * FROM (SELECT k, beat, pos, lead(v, 2) OVER w - 2 * lead(v) OVER w + v AS v FROM (SELECT k, beat, pos, v - (first_value(v) OVER a + (last_value(v) OVER a - first_value(v) OVER a) * pos / greatest(count(*) OVER a - 1, 1)) AS v FROM eb WINDOW a AS (PARTITION BY k, beat ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WINDOW w AS (PARTITION BY k, beat ORDER BY pos)) WHERE v IS NOT NULL)"
_CHECK2 = """p5 AS (SELECT * FROM (SELECT *, row_number() OVER w AS nth, pos - lag(pos) OVER w AS gap FROM tn WINDOW w AS (PARTITION BY k, beat ORDER BY pos)) WHERE nth <= 5),
 t5 AS (SELECT k, beat, count(*) AS turns, max(v) AS top, min(v) AS low, min(gap) AS gap, max(v) FILTER (WHERE nth = 1) AS a, max(v) FILTER (WHERE nth = 2) AS b FROM p5 GROUP BY k, beat),
 ok2 AS (SELECT sz.k, sz.beat, coalesce(turns = 5 AND a = top AND b = low AND gap >= 0.03 * n, false) AS good FROM sz LEFT JOIN t5 ON sz.k = t5.k AND sz.beat = t5.beat)"""


def _easy(spark, d):
    return cut_beats(spark, d).withColumn("pos", F.floor(F.col("pos") / 6)).groupBy("k", "beat", "pos").agg((F.floor(F.round(F.avg("v") * 10, 9)) / 10).alias("v"))


@query(f"WITH {BT}, {_EASY}, {_TURNS.format('eb')}, {_CHECK1} SELECT k, beat, good FROM ok1")
def beat_check_ppg(spark, d):
    return beats.check_pulse(_easy(spark, d))


_STEPS = "sr AS (SELECT k, beat, pos, round(v, 6) AS v FROM sd)"
_USUAL = """fb AS (SELECT k, beat, v - (first_value(v) OVER a + (last_value(v) OVER a - first_value(v) OVER a) * pos / greatest(count(*) OVER a - 1, 1)) AS v FROM eb WINDOW a AS (PARTITION BY k, beat ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 st AS (SELECT k, beat, round(sum(v), 9) AS area, count(*) AS duration, max(v) AS amplitude FROM fb GROUP BY k, beat), us AS (SELECT k, beat FROM (SELECT k, beat, """ + " AND ".join(f"round(abs({c} - avg({c}) OVER (PARTITION BY k)), 9) <= round(stddev_pop({c}) OVER (PARTITION BY k), 9)" for c in ("area", "duration", "amplitude")) + """ AS near FROM st) WHERE near)"""


def _tagged(sql: str, tag: str) -> str:
    """The turns' tables under names of their own."""
    return re.sub(r"\b(rn|ru|fl|nb|tn|sz)\b", rf"\g<1>{tag}", sql)


@query(f"WITH {BT}, {_EASY}, {_SECOND}, {_STEPS}, {_TURNS.format('sr')}, {_CHECK2} SELECT k, beat, good FROM ok2")
def beat_check_sdppg(spark, d):
    return beats.check_second_derivative(beats.second_differences(_easy(spark, d)))


@query(f"""WITH {BT}, {_EASY}, {_SECOND}, {_STEPS}, {_tagged(_TURNS.format('eb'), '1')}, {_tagged(_CHECK1, '1')}, {_tagged(_TURNS.format('sr'), '2')}, {_tagged(_CHECK2, '2')}, {_USUAL}
SELECT k, beat FROM ok1 WHERE good INTERSECT SELECT k, beat FROM ok2 WHERE good INTERSECT SELECT k, beat FROM us""")
def beat_accepted(spark, d):
    return beats.accepted(_easy(spark, d))


@query()
def beat_representative(spark, d):
    x = cut_beats(spark, d)
    return beats.representative(x, beats.usual(beats.statistics(x)), 100).select("k", "pos", r6("v").alias("v"))


@query()
def beat_derivative_features(spark, d):
    return beats.derivative_features(_smooth(spark, d), 200).select("k", "beat", *(r6(c, 4).alias(c) for c in beats.WAVES))


@query()
def features_per_series(spark, d):
    x = _smooth(spark, d)
    both = beats.contour(x).join(beats.derivative_features(x, 200), ["k", "beat"])
    return beats.mean_features(both, ["k"]).select("k", "beats", *(r6(c, 4).alias(c) for c in ("t1", "t_div", "systolic_share", "up50", "down50", "ageing", "wi1", "v_top")))


def _smooth(spark, d):
    """Beats as the mean of eight neighbouring samples."""
    return cut_beats(spark, d).withColumn("pos", F.floor(F.col("pos") / 8)).groupBy("k", "beat", "pos").agg(F.avg("v").alias("v"))
