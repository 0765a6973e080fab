"""The registered queries: each operator on the driver's tables, and the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions.windows import filled, minmax, series, whole, zscore
from tidewave.operators import beats, colour, filters, metrics, relational, signal, splits
from tidewave.sources.tables import colour_traces, cut_beats, event_signals, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RGB = """rgb AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS t,
 l_quantity AS r, l_extendedprice / 1000 AS g, 1 + 100 * l_discount AS b FROM lineitem)"""
EV = "ev AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, epoch_us(ts) / 1e6 AS sec, event_type AS channel, value AS v FROM events)"
BT = "bt AS (SELECT k, beat, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM (SELECT CAST(label AS BIGINT) AS k, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS beat, embedding FROM embeddings))"
VALLEYS = """low AS (SELECT *, coalesce(v < min(v) OVER (PARTITION BY k ORDER BY t ROWS 2 PRECEDING EXCLUDE CURRENT ROW) AND v < min(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), false) AS valley FROM ev),
 ids AS (SELECT *, sum(CAST(valley AS BIGINT)) OVER (PARTITION BY k ORDER BY t) AS beat, sum(CAST(valley AS BIGINT)) OVER (PARTITION BY k) AS beats FROM low),
 cut AS (SELECT k, CAST(beat AS BIGINT) AS beat, row_number() OVER (PARTITION BY k, beat ORDER BY t) - 1 AS pos, t, v FROM ids WHERE beat > 0 AND beat < beats)"""
PAIR = "pair AS (SELECT l_suppkey AS k, l_quantity AS y, l_quantity + 100 * (l_discount - 0.05) AS p FROM lineitem)"
R6 = "round({}, 6) + 0.0".format
#: For means and lines of values with few decimals, whose sixth decimal may sit on a half.
R9 = "round({}, 9) + 0.0".format


def r6(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + 0.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _values(df: DataFrame) -> DataFrame:
    return df.select("k", "t", r6("v").alias("v"))


# colour to pulse

W, ALL = "OVER (PARTITION BY k ORDER BY t)", "OVER (PARTITION BY k)"


@query(f"WITH {RGB} SELECT k, t, {R6('-g')} AS v FROM rgb")
def pulse_green(spark, d):
    return _values(colour.green(colour_traces(spark, d)))


@query(f"""WITH {RGB}, xy AS (SELECT k, t, 3 * r - 2 * g AS x, 1.5 * r + g - 1.5 * b AS y FROM rgb)
SELECT k, t, {R6(f"-(x - stddev_pop(x) {ALL} / (stddev_pop(y) {ALL} + 1e-6) * y)")} AS v FROM xy""")
def pulse_chrom(spark, d):
    return _values(colour.chrom(colour_traces(spark, d)))


_AHEAD, _BEHIND = "OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING)", "OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {RGB}, m AS (SELECT *, count(*) {_AHEAD} AS n, avg(r) {_AHEAD} AS mr, avg(g) {_AHEAD} AS mg, avg(b) {_AHEAD} AS mb, var_pop(r) {_AHEAD} AS vr, var_pop(g) {_AHEAD} AS vg, var_pop(b) {_AHEAD} AS vb,
 covar_pop(g, b) {_AHEAD} AS cgb, covar_pop(r, g) {_AHEAD} AS crg, covar_pop(r, b) {_AHEAD} AS crb FROM rgb),
 s AS (SELECT *, 1 / (mr + 1e-6) AS kr, 1 / (mg + 1e-6) AS kg, 1 / (mb + 1e-6) AS kb FROM m),
 al AS (SELECT *, sqrt(greatest(kg * kg * vg + kb * kb * vb - 2 * kg * kb * cgb, 0)) / (sqrt(greatest(4 * kr * kr * vr + kg * kg * vg + kb * kb * vb - 4 * kr * kg * crg - 4 * kr * kb * crb + 2 * kg * kb * cgb, 0)) + 1e-6) AS al FROM s),
 a AS (SELECT k, t, r, g, b, CASE WHEN n = 48 THEN -2 * al * kr END AS a1, CASE WHEN n = 48 THEN kg * (1 + al) END AS a2, CASE WHEN n = 48 THEN kb * (al - 1) END AS a3,
 CASE WHEN n = 48 THEN -2 * al * kr * mr + kg * (1 + al) * mg + kb * (al - 1) * mb END AS a4 FROM al)
SELECT k, t, {R6(f"r * coalesce(sum(a1) {_BEHIND}, 0) + g * coalesce(sum(a2) {_BEHIND}, 0) + b * coalesce(sum(a3) {_BEHIND}, 0) - coalesce(sum(a4) {_BEHIND}, 0)")} AS v FROM a""")
def pulse_pos(spark, d):
    return _values(colour.pos(colour_traces(spark, d)))


@query(f"""WITH {RGB}, q AS (SELECT *, first_value(r) {W} AS qr, first_value(g) {W} AS qg, first_value(b) {W} AS qb FROM rgb)
SELECT k, t, {R6("g - qg * (qr * r + qg * g + qb * b) / nullif(qr * qr + qg * qg + qb * qb, 0)")} AS v FROM q""")
def pulse_omit(spark, d):
    return _values(colour.omit(colour_traces(spark, d)))


NORMAL = f"x AS (SELECT k, t, r / (avg(r) {ALL} + 1e-6) AS r, g / (avg(g) {ALL} + 1e-6) AS g, b / (avg(b) {ALL} + 1e-6) AS b FROM rgb)"
_HR, _HG, _HB = (repr(w) for w in colour.hemo_weights())


@query(f"""WITH {RGB}, {NORMAL}, top AS (SELECT CASE WHEN max(greatest(r, g, b)) > 1.5 THEN 255.0 ELSE 1.0 END AS s FROM x),
 y AS (SELECT k, t, -ln(least(greatest(r / s, 1e-8), 1.0)) AS r, -ln(least(greatest(g / s, 1e-8), 1.0)) AS g, -ln(least(greatest(b / s, 1e-8), 1.0)) AS b FROM x, top)
SELECT k, t, {R6(f"exp(-greatest(CAST({_HR} AS DOUBLE) * r + CAST({_HG} AS DOUBLE) * g + CAST({_HB} AS DOUBLE) * b, 0.0))")} AS v FROM y""")
def pulse_hemo(spark, d):
    return _values(colour.hemo(colour_traces(spark, d)))


@query(f"""WITH {RGB}, {NORMAL},
 q AS (SELECT *, sum(r * r) {ALL} + 1e-6 AS rr, sum(g * g) {ALL} + 1e-6 AS gg, sum(b * b) {ALL} + 1e-6 AS bb, sum(r * g) {ALL} AS rg, sum(r * b) {ALL} AS rb, sum(g * b) {ALL} AS gb,
 sqrt(var_pop(r) {ALL} + var_pop(g) {ALL} + var_pop(b) {ALL}) + 1e-6 AS sc, stddev_pop(r) {ALL} AS sr, stddev_pop(g) {ALL} AS sg, stddev_pop(b) {ALL} AS sb FROM x),
 u AS (SELECT *, sr / sc AS p, sg / sc AS q, sb / sc AS s, rr * (gg * bb - gb * gb) - rg * (rg * bb - gb * rb) + rb * (rg * gb - gg * rb) AS det FROM q),
 w AS (SELECT k, t, r, g, b, p, q, s, (p * (gg * bb - gb * gb) - rg * (q * bb - gb * s) + rb * (q * gb - gg * s)) / nullif(det, 0) AS wr,
 (rr * (q * bb - gb * s) - p * (rg * bb - gb * rb) + rb * (rg * s - q * rb)) / nullif(det, 0) AS wg, (rr * (gg * s - q * gb) - rg * (rg * s - q * rb) + p * (rg * gb - gg * rb)) / nullif(det, 0) AS wb FROM u)
SELECT k, t, {R6("(r * wr + g * wg + b * wb) / (p * wr + q * wg + s * wb + 1e-6)")} AS v FROM w""")
def pulse_pbv(spark, d):
    return _values(colour.pbv(colour_traces(spark, d)))


@query()
def pulse_lgi(spark, d):
    return _values(colour.lgi(colour_traces(spark, d)))


@query()
def pulse_pca(spark, d):
    return _values(colour.pca(colour_traces(spark, d)))


@query(f"WITH {RGB}, {NORMAL} SELECT k, t, {R6('r')} AS r, {R6('g')} AS g, {R6('b')} AS b FROM x")
def rgb_color_normalize(spark, d):
    return colour.normalised(colour_traces(spark, d)).select("k", "t", *(r6(c).alias(c) for c in "rgb"))


@query(f"""WITH {EV}, gap AS (SELECT k, t, CASE WHEN channel IN (SELECT min(event_type) FROM events) OR t % 7 = 0 THEN NULL ELSE v END AS v FROM ev),
 near AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t) AS t0, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t) AS v0,
 first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1,
 first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM gap)
SELECT k, t, {R6("coalesce(v, v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0), v0, v1, 0)")} AS v FROM near""")
def rgb_fill_nan(spark, d):
    x = event_signals(spark, d)
    first = x.agg(F.min("channel").alias("c0"))
    gaps = x.join(F.broadcast(first)).select("k", "t", F.when((F.col("channel") != F.col("c0")) & (F.col("t") % 7 != 0), F.col("v")).alias("v"))
    return gaps.select("k", "t", r6(filled("v", "t", series("k", "t"))).alias("v"))


@query(f"WITH {RGB}, n AS (SELECT min(n) AS n FROM (SELECT max(t) AS n FROM rgb GROUP BY k)) SELECT k, t, r, {R6('g')} AS g, {R6('b')} AS b FROM rgb, n WHERE t <= n")
def rgb_min_length(spark, d):
    return colour.to_shortest(colour_traces(spark, d)).select("k", "t", "r", r6("g").alias("g"), r6("b").alias("b"))


@query(f"""WITH {RGB} SELECT n_name AS "group", t, {R9('avg(r)')} AS r, {R9('avg(g)')} AS g, {R9('avg(b)')} AS b FROM rgb JOIN supplier ON k = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, t""")
def roi_group_mean(spark, d):
    bridge = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), F.col("n_name").alias("group"))
    return colour.group_mean(colour_traces(spark, d), bridge).select("group", "t", *(r6(c, 9).alias(c) for c in "rgb"))


@query(f"WITH {RGB} SELECT k, t, {R6(f'sqrt((r - first_value(r) {W}) ** 2 + (g - first_value(g) {W}) ** 2)')} AS v FROM rgb")
def roi_drift(spark, d):
    return _values(colour.drift(colour_traces(spark, d), "r", "g"))


# signals


@query(f"WITH {EV} SELECT k, t, {R6(f'CASE WHEN max(v) {ALL} - min(v) {ALL} < 1e-8 THEN 0 ELSE (v - min(v) {ALL}) / nullif(max(v) {ALL} - min(v) {ALL}, 0) END')} AS v FROM ev")
def sig_minmax(spark, d):
    return event_signals(spark, d).select("k", "t", r6(minmax("v", whole("k"))).alias("v"))


@query(f"WITH {EV} SELECT k, t, {R6('(v - (SELECT min(v) FROM ev)) / (SELECT nullif(max(v) - min(v), 0) FROM ev)')} AS v FROM ev")
def sig_minmax_global(spark, d):
    x = event_signals(spark, d)
    ends = x.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return x.join(F.broadcast(ends)).select("k", "t", r6((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).alias("v"))


@query(f"WITH {EV} SELECT k, t, {R6(f'CASE WHEN stddev_pop(v) {ALL} < 1e-8 THEN 0 ELSE (v - avg(v) {ALL}) / (stddev_pop(v) {ALL} + 1e-8) END')} AS v FROM ev")
def sig_zscore_pop(spark, d):
    return event_signals(spark, d).select("k", "t", r6(zscore("v", whole("k"))).alias("v"))


@query(f"WITH {EV} SELECT k, t, {R6(f'(v - avg(v) {ALL}) / nullif(stddev_samp(v) {ALL}, 0)')} AS v FROM ev")
def sig_zscore_samp(spark, d):
    w = whole("k")
    return event_signals(spark, d).select("k", "t", r6((F.col("v") - F.avg("v").over(w)) / F.nullif(F.stddev_samp("v").over(w), F.lit(0.0))).alias("v"))


@query(f"WITH {EV} SELECT k, t, {R6(f'max(v) {ALL} - v')} AS v FROM ev")
def sig_reverse(spark, d):
    return _values(signal.reversed_signal(event_signals(spark, d)))


@query(f"""WITH {EV}, a AS (SELECT *, lead(v) {W} - v AS d1 FROM ev), b AS (SELECT *, lead(d1) {W} - d1 AS d2 FROM a), c AS (SELECT *, lead(d2) {W} - d2 AS d3 FROM b)
SELECT k, t, {R6('d1')} AS d1, {R6('d2')} AS d2, {R6('d3')} AS d3, {R6(f'lead(d3) {W} - d3')} AS d4 FROM c""")
def sig_diff4(spark, d):
    return signal.differences(event_signals(spark, d)).select("k", "t", *(r6(f"d{i}").alias(f"d{i}") for i in range(1, 5)))


def _grad(v: str) -> str:
    return f"coalesce((lead({v}) {W} - lag({v}) {W}) / 2, lead({v}) {W} - {v}, {v} - lag({v}) {W})"


@query(f"WITH {EV}, a AS (SELECT *, {_grad('v')} AS g1 FROM ev) SELECT k, t, {R6('g1')} AS g1, {R6(_grad('g1'))} AS g2 FROM a")
def sig_gradient2(spark, d):
    return signal.gradients(event_signals(spark, d)).select("k", "t", r6("g1").alias("g1"), r6("g2").alias("g2"))


@query(f"""WITH {EV}, q AS (SELECT k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM ev GROUP BY k)
SELECT ev.k, t, CASE WHEN v BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a) THEN v END AS v, NOT v BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a) AS outlier FROM ev JOIN q ON ev.k = q.k""")
def sig_outlier_iqr(spark, d):
    return signal.without_outliers(event_signals(spark, d), 0.3)


@query(f"""WITH {EV}, e AS (SELECT *, first_value(v) {W} AS a, last_value(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, count(*) {ALL} AS n FROM ev)
SELECT k, t, {R9('v - (a + (z - a) * ((t - 1) / greatest(n - 1, 1)))')} AS v FROM e""")
def sig_baseline_linear(spark, d):
    return signal.without_chord(event_signals(spark, d)).select("k", "t", r6("v", 9).alias("v"))


@query(f"""WITH {EV}, x AS (SELECT *, lead(v) {W} AS nv FROM ev), n AS (SELECT k, max(t) AS n FROM ev GROUP BY k), g AS (SELECT k, i, (n - 1) * i / 29.0::DOUBLE AS p FROM n, range(30) r(i))
SELECT g.k, g.i, {R6('v + (coalesce(nv, v) - v) * (p - floor(p))')} AS v FROM g JOIN x ON x.k = g.k AND x.t = floor(p) + 1""")
def sig_resample_linear(spark, d):
    return signal.resampled(event_signals(spark, d), 30).select("k", "i", r6("v").alias("v"))


@query(f"WITH {EV} SELECT k, t, v FROM ev WHERE t BETWEEN 16 AND 45")
def sig_time_slice(spark, d):
    return signal.time_slice(event_signals(spark, d), 0.5, 1.0, 30.0).select("k", "t", "v")


@query("SELECT k, day, v FROM (SELECT user_id AS k, CAST(ts AS DATE) AS day, value AS v, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def sig_dedup_time(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("day"), F.col("value").alias("v"), "ts", "event_id")
    return signal.first_of_time(x, "day", ["ts", "event_id"]).select("k", "day", "v")


@query("""WITH s AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), l AS (SELECT user_id AS k, epoch_us(ts) / 1e6 AS sec FROM events, s WHERE event_type = a), r AS (SELECT user_id AS k, epoch_us(ts) / 1e6 AS sec, value AS v FROM events, s WHERE event_type = b),
 z AS (SELECT k, max_by(v, sec) AS v FROM r GROUP BY k)
SELECT l.k, l.sec, coalesce(r.v, z.v) AS v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.sec <= r.sec LEFT JOIN z ON l.k = z.k""")
def sig_asof_forward(spark, d):
    x = event_signals(spark, d)
    ends = x.agg(F.min("channel").alias("a"), F.max("channel").alias("b"))
    x = x.join(F.broadcast(ends))
    return signal.aligned_forward(x.where("channel = a"), x.where("channel = b"))


_EXTREME = "coalesce(v {0} {1}(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AND v {0} {1}(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), false)"
VALLEYS = VALLEYS[: VALLEYS.index("coalesce")] + _EXTREME.format("<", "min") + VALLEYS[VALLEYS.index(" AS valley") :]


@query(f"WITH {EV} SELECT k, t, v, {_EXTREME.format('>', 'max')} AS peak, {_EXTREME.format('<', 'min')} AS valley FROM ev")
def sig_peaks(spark, d):
    return signal.extrema(event_signals(spark, d), 2).select("k", "t", "v", "peak", "valley")


@query(f"""WITH {EV}, low AS (SELECT k, t FROM (SELECT k, t, {_EXTREME.format('<', 'min')} AS valley FROM ev) WHERE valley), gap AS (SELECT k, (lead(t) OVER (PARTITION BY k ORDER BY t) - t) / 6.0::DOUBLE AS g FROM low), ok AS (SELECT k, CASE WHEN g BETWEEN 0.33 AND 1.5 THEN g END AS g FROM gap)
SELECT k, count(g) AS n, {R6('60 / avg(g)')} AS bpm FROM ok GROUP BY k""")
def sig_ibi_hr(spark, d):
    return signal.heart_rate(event_signals(spark, d), 6.0, 2).select("k", "n", r6("bpm").alias("bpm"))


@query(f"""WITH {EV}, n AS (SELECT k, count(*) AS n, avg(v) AS m FROM ev GROUP BY k), s AS (SELECT ev.k, bin, max(n) AS n, sum((v - m) * cos(2 * pi() * bin * (t - 1) / n)) AS c, sum((v - m) * sin(2 * pi() * bin * (t - 1) / n)) AS s FROM ev JOIN n ON ev.k = n.k, range(1, 17) r(bin) GROUP BY ev.k, bin),
 p AS (SELECT k, bin, n, c * c + s * s AS power FROM s) SELECT k, max_by(bin, round(power, 4)) AS bin, round(max(power), 4) AS power FROM p GROUP BY k""")
def sig_dft_hr(spark, d):
    power = signal.spectrum(event_signals(spark, d), 16)
    return power.groupBy("k").agg(F.max_by("bin", F.round("power", 4)).alias("bin"), F.round(F.max("power"), 4).alias("power"))


_Z = "(v - avg(v) OVER (PARTITION BY k, win)) / (stddev_pop(v) OVER (PARTITION BY k, win) + 1e-8)"


@query(f"WITH {EV}, x AS (SELECT *, (t - 1) // 10 AS win, max(t) {ALL} AS n FROM ev) SELECT k, win, t - 1 - win * 10 AS pos, {R6(_Z)} AS v FROM x WHERE win * 10 + 10 <= n")
def win_tumbling_z(spark, d):
    return signal.windowed(event_signals(spark, d), 10, 10).select("k", "win", "pos", r6("v").alias("v"))


@query(f"WITH {EV}, n AS (SELECT k, max(t) AS n FROM ev GROUP BY k), s AS (SELECT k, win FROM n, range(100000) r(win) WHERE win * 5 + 10 <= n), x AS (SELECT ev.k, win, t, v FROM ev JOIN s ON ev.k = s.k AND t - 1 >= win * 5 AND t - 1 < win * 5 + 10) SELECT k, win, t - 1 - win * 5 AS pos, {R6(_Z)} AS v FROM x")
def win_sliding_z(spark, d):
    return signal.windowed(event_signals(spark, d), 10, 5).select("k", "win", "pos", r6("v").alias("v"))


# beats

FLAT = """flat AS (SELECT k, beat, v - (first_value(v) OVER w + (last_value(v) OVER w - first_value(v) OVER w) * pos / greatest(count(*) OVER w - 1, 1)) AS v FROM cut WINDOW w AS (PARTITION BY k, beat ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 st AS (SELECT k, beat, sum(v) AS area, count(*) AS duration, max(v) AS amplitude FROM flat GROUP BY k, beat)"""


@query(f"WITH {EV}, {VALLEYS}, {FLAT} SELECT k, beat, {R6('area')} AS area, duration, {R6('amplitude')} AS amplitude FROM st")
def beat_stats(spark, d):
    return beats.statistics(beats.cut(event_signals(spark, d), 2)).select("k", "beat", r6("area").alias("area"), "duration", r6("amplitude").alias("amplitude"))


_NEAR = " AND ".join(f"round(abs({c} - avg({c}) {ALL}), 9) <= round(stddev_pop({c}) {ALL}, 9)" for c in ("area", "duration", "amplitude"))


@query(f"WITH {EV}, {VALLEYS}, {FLAT} SELECT k, beat FROM (SELECT k, beat, {_NEAR} AS near FROM st) WHERE near")
def beat_select_1sigma(spark, d):
    return beats.usual(beats.statistics(beats.cut(event_signals(spark, d), 2))).select("k", "beat")


_G = "coalesce((lead(v) OVER w - lag(v) OVER w) / 2, lead(v) OVER w - v, v - lag(v) OVER w)"
SQI = f"""g1 AS (SELECT k, beat, pos, {_G} AS v FROM bt WINDOW w AS (PARTITION BY k, beat ORDER BY pos)), g2 AS (SELECT k, beat, pos, {_G} AS v FROM g1 WINDOW w AS (PARTITION BY k, beat ORDER BY pos)),
 sqi AS (SELECT a.k, a.beat, covar_pop(a.v, b.v) / nullif(stddev_pop(CASE WHEN b.v IS NOT NULL THEN a.v END) * stddev_pop(b.v), 0) AS sqi FROM g2 a LEFT JOIN g2 b ON a.k = b.k AND b.beat = a.beat + 1 AND a.pos = b.pos GROUP BY a.k, a.beat)"""


@query(f"WITH {BT}, {SQI} SELECT k, beat, {R6('sqi')} AS sqi FROM sqi")
def sqi_adjacent(spark, d):
    return beats.quality(cut_beats(spark, d)).select("k", "beat", r6("sqi").alias("sqi"))


@query(f"WITH {BT}, {SQI} SELECT k, beat, coalesce(sqi >= 0.05, false) AS good FROM sqi")
def sqi_mask(spark, d):
    return beats.good(beats.quality(cut_beats(spark, d)), 0.05).select("k", "beat", "good")


@query(f"WITH {BT}, {SQI}, ok AS (SELECT k, beat, beat - row_number() OVER (PARTITION BY k ORDER BY beat) AS run FROM sqi WHERE sqi >= 0.05) SELECT k, min(beat) AS first, max(beat) AS last FROM ok GROUP BY k, run")
def sqi_ranges(spark, d):
    return beats.ranges(beats.good(beats.quality(cut_beats(spark, d)), 0.05))


@query(f"WITH {BT}, s AS (SELECT k, pos, CASE WHEN max(v) OVER w - min(v) OVER w <= 1e-8 THEN 0 ELSE (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) * 2 END AS v FROM bt WINDOW w AS (PARTITION BY k, beat)) SELECT k, pos, {R6('avg(v)')} AS v FROM s GROUP BY k, pos")
def beat_t2_mean(spark, d):
    return beats.scaled_mean(cut_beats(spark, d)).select("k", "pos", r6("v").alias("v"))


_CONTOUR = ["t1", "t2", "t_sub", "t_div", "systolic", "diastolic", "area_ratio", "slope_up", "slope_down"]
_SIDE = "min_by(pos, row(abs(v - top * ({0} / 100.0::DOUBLE)), pos)) FILTER (WHERE pos {1} pk)"


@query(f"""WITH {BT}, p AS (SELECT k, beat, pos, v, count(*) OVER w AS n, max(v) OVER w AS top FROM bt WINDOW w AS (PARTITION BY k, beat)),
 a AS (SELECT *, min(CASE WHEN v = top THEN pos END) OVER (PARTITION BY k, beat) AS pk FROM p),
 f AS (SELECT k, beat, max(n) AS n, max(top) AS top, max(pk) AS t1, min_by(v, pos) AS va, max_by(v, pos) AS vz, sum(v) FILTER (WHERE pos <= pk) AS systolic, sum(v) FILTER (WHERE pos >= pk) AS diastolic,
 {", ".join(f"{_SIDE.format(x, '>=')} - {_SIDE.format(x, '<=')} AS width{x}" for x in beats.LEVELS)} FROM a GROUP BY k, beat), g AS (SELECT *, greatest(n - t1, 1) AS t2 FROM f)
SELECT k, beat, t1, t2, abs(t1 - t2) AS t_sub, {R6('t1 / t2')} AS t_div, {R6('systolic')} AS systolic, {R6('diastolic')} AS diastolic, {R6('systolic / nullif(diastolic, 0)')} AS area_ratio, {R6('(top - va) / nullif(t1, 0)')} AS slope_up, {R6('(vz - top) / nullif(n - t1, 0)')} AS slope_down,
 {", ".join(f"width{x}" for x in beats.LEVELS)} FROM g""")
def beat_contour(spark, d):
    found = beats.contour(cut_beats(spark, d))
    whole_numbers = ("t1", "t2", "t_sub")
    return found.select("k", "beat", *(F.col(c).cast("long") if c in whole_numbers else r6(c).alias(c) for c in _CONTOUR), *(f"width{x}" for x in beats.LEVELS))


@query(f"""WITH {BT}, w AS (SELECT k, beat, max(v) FILTER (WHERE pos = 0) AS a, max(v) FILTER (WHERE pos = 1) AS b, max(v) FILTER (WHERE pos = 2) AS c, max(v) FILTER (WHERE pos = 3) AS d, max(v) FILTER (WHERE pos = 4 AND beat % 2 = 0) AS e FROM bt GROUP BY k, beat)
SELECT k, beat, {R6('b / nullif(a, 0)')} AS b_a, {R6('CASE WHEN e IS NOT NULL THEN (b - c - d - e) / nullif(a, 0) ELSE (b - c - d) / nullif(a, 0) END')} AS ageing, {R6('(d - b) / nullif(a, 0)')} AS wi1, {R6('(a - b) / nullif(a - d, 0)')} AS ab_ad FROM w""")
def beat_dr_ratios(spark, d):
    x = cut_beats(spark, d)
    waves = x.groupBy("k", "beat").agg(*(F.max(F.when((F.col("pos") == i) & ((F.col("beat") % 2 == 0) if c == "e" else F.lit(True)), F.col("v"))).alias(c) for i, c in enumerate("abcde")))
    return beats.derivative_ratios(waves).select("k", "beat", *(r6(c).alias(c) for c in ("b_a", "ageing", "wi1", "ab_ad")))


# relations

_KINDS = "(SELECT DISTINCT user_id AS sid, event_type AS source FROM events WHERE value > 60)"
SOURCES = ["click", "purchase", "view"]


def _sources(spark, d):
    return table(spark, d, "events").where("value > 60").select(F.col("user_id").alias("sid"), F.col("event_type").alias("source"))


_LIST = ", ".join(f"'{s}'" for s in SOURCES)


@query(f"SELECT sid FROM {_KINDS} WHERE source IN ({_LIST}) GROUP BY sid HAVING count(DISTINCT source) = {len(SOURCES)}")
def multi_intersect(spark, d):
    return relational.in_all(_sources(spark, d), SOURCES)


@query(f"WITH h AS (SELECT * FROM {_KINDS} WHERE source IN ({_LIST})), a AS (SELECT DISTINCT sid FROM {_KINDS}), m AS (SELECT a.sid, s.source FROM a, (SELECT unnest([{_LIST}]) AS source) s ANTI JOIN h ON a.sid = h.sid AND s.source = h.source) SELECT sid, string_agg(source, ',' ORDER BY source) AS missing FROM m GROUP BY sid")
def multi_missing(spark, d):
    return relational.missing_sources(_sources(spark, d), SOURCES)


@query("WITH p AS (SELECT page_id, url, regexp_extract(url, '([^/]+?)(?:\\.[^./]*)?$', 1) AS stem FROM pages) SELECT a.stem, a.url AS left_path, b.url AS right_path FROM p a JOIN p b ON a.stem = b.stem WHERE a.page_id % 2 = 0 AND b.page_id % 2 = 1")
def pair_stem_join(spark, d):
    pages = table(spark, d, "pages")
    return relational.pairs_by_stem(pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1"), "url", ("page_id",))


@query("SELECT user_id AS k, CAST(ts AS DATE) AS day, " + ", ".join(f"{R6(f'avg(value) FILTER (WHERE event_type = {chr(39)}{s}{chr(39)})')} AS {s}" for s in SOURCES) + " FROM events GROUP BY user_id, CAST(ts AS DATE)")
def pivot_channels(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("day"), F.col("event_type").alias("channel"), F.col("value").alias("v"))
    return relational.channels(x, SOURCES, ["k", "day"]).select("k", "day", *(r6(s).alias(s) for s in SOURCES))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def semi_has_ppg(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing_files(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(f"WITH {BT}, {SQI}, n AS (SELECT k, beat, count(*) AS n FROM bt GROUP BY k, beat) SELECT n.k, n.beat, n.n, {R6('sqi')} AS sqi FROM n LEFT JOIN (SELECT * FROM sqi WHERE sqi >= 0.05) s ON n.k = s.k AND n.beat = s.beat")
def left_join_sqi(spark, d):
    x = cut_beats(spark, d)
    return x.groupBy("k", "beat").agg(F.count(F.lit(1)).alias("n")).join(beats.quality(x).where("sqi >= 0.05"), ["k", "beat"], "left").select("k", "beat", "n", r6("sqi").alias("sqi"))


@query("SELECT doc_id, source, quality, toxic, n_chars FROM (SELECT d.*, quality, toxic, row_number() OVER (PARTITION BY source, quality, toxic ORDER BY doc_id) AS n FROM documents d JOIN labels USING (doc_id)) WHERE n = 1")
def label_join_dedup(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return relational.first_of(joined, ["source", "quality", "toxic"], ["doc_id"]).select("doc_id", "source", "quality", "toxic", "n_chars")


@query("SELECT l_suppkey AS k, l_shipmode AS x, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, k, x LIMIT 10".replace("l_shipmode", "l_returnflag"))
def group_count_top10(spark, d):
    return relational.most_frequent(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("x")), ["k", "x"])


@query("SELECT column_name AS name FROM (DESCRIBE lineitem) WHERE column_type IN ('DOUBLE', 'INTEGER', 'BIGINT') AND column_name NOT IN ('l_orderkey', 'l_partkey', 'l_suppkey')")
def feature_cols_numeric(spark, d):
    names = relational.numeric_columns(table(spark, d, "lineitem"), ("l_orderkey", "l_partkey", "l_suppkey"))
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"))


@query("SELECT page_id, list_extract(p, -4) AS subject, list_extract(p, -3) AS method, list_extract(p, -2) AS roi FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)")
def path_parse(spark, d):
    return table(spark, d, "pages").select("page_id", *relational.path_parts(F.col("url")))


@query("SELECT c_custkey, nullif(CASE WHEN e <> '' THEN e ELSE regexp_extract(s, '(\\d+)', 1) END, '') AS sid FROM (SELECT c_custkey, s, regexp_extract(s, '(?:^|\\D)(\\d{3})(?:\\D|$)', 1) AS e FROM (SELECT c_custkey, c_custkey || '_' || c_name AS s FROM customer))")
def sid_extract(spark, d):
    return table(spark, d, "customer").select("c_custkey", relational.subject_id(F.concat_ws("_", F.col("c_custkey").cast("string"), "c_name")).alias("sid"))


@query("SELECT o_orderkey, TRY_CAST(regexp_extract(o_orderpriority, '^(\\S+)', 1)[1:1] AS DOUBLE) AS value, nullif(regexp_extract(o_orderpriority, '^\\S+\\s+(.*)$', 1), '') AS rest FROM orders")
def pw_parse(spark, d):
    line = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.regexp_extract(line, r"^(\S+)", 1), 1, 1).try_cast("double").alias("value"), F.nullif(F.regexp_extract(line, r"^\S+\s+(.*)$", 1), F.lit("")).alias("rest"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS n FROM part")
def natural_sort(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.concat(F.lit("img"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"))
    return relational.global_rank(named, relational.natural_key(F.col("name")), "n").select("p_partkey", (F.col("n") + 1).alias("n"))


@query(f"WITH {EV} SELECT k, t FROM ev WHERE (t - 1) % 3 = 0 AND (t - 1) / 30.0 <= 1.5")
def frame_decimate(spark, d):
    return relational.every_kth(event_signals(spark, d).withColumn("frame", F.col("t") - 1), 30.0, 10.0, 1.5).select("k", "t")


# metrics and splits


def _pair(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("y"), (F.col("l_quantity") + 100 * (F.col("l_discount") - 0.05)).alias("p"))


@query(f"WITH {PAIR} SELECT k, count(*) AS n, {R6('avg(abs(p - y))')} AS mae, {R6('sqrt(avg((p - y) * (p - y)))')} AS rmse, {R6('covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p) + 1e-12)')} AS r FROM pair GROUP BY k")
def eval_mae_rmse_r(spark, d):
    return metrics.errors(_pair(spark, d), ["k"]).select("k", "n", *(r6(c).alias(c) for c in ("mae", "rmse", "r")))


@query(f"WITH {PAIR} SELECT k, {R6('avg(p - y)')} AS me, {R6('coalesce(stddev_samp(p - y), 0)')} AS sd, {R6('avg(abs(p - y))')} AS mae, abs(avg(p - y)) <= 5 AND coalesce(stddev_samp(p - y), 0) <= 8 AS passes FROM pair GROUP BY k")
def eval_aami(spark, d):
    return metrics.aami(_pair(spark, d), ["k"]).select("k", *(r6(c).alias(c) for c in ("me", "sd", "mae")), "passes")


def _bhs(op: str) -> str:
    share = ", ".join(f"avg(CASE WHEN abs(p - y) {op} {n} THEN 1.0::DOUBLE ELSE 0 END) AS within{n}" for n in metrics.LIMITS)
    grade = "".join(f" WHEN within5 >= {a} AND within10 >= {b} AND within15 >= {c} THEN '{g}'" for g, a, b, c in metrics.BHS)
    pair = PAIR.replace("l_quantity + 100 * (l_discount - 0.05) AS p", "l_quantity + 200.5 * l_tax AS p")
    return f"WITH {pair}, s AS (SELECT k, {share} FROM pair GROUP BY k) SELECT k, {', '.join(f'{R6(f'within{n}')} AS within{n}' for n in metrics.LIMITS)}, CASE{grade} ELSE 'D' END AS grade FROM s"


def _graded(spark, d, strict: bool) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("y"), (F.col("l_quantity") + 200.5 * F.col("l_tax")).alias("p"))
    return metrics.bhs(x, ["k"], strict=strict).select("k", *(r6(f"within{n}").alias(f"within{n}") for n in metrics.LIMITS), "grade")


@query(_bhs("<="))
def eval_bhs(spark, d):
    return _graded(spark, d, False)


@query(_bhs("<"))
def eval_bhs_strict(spark, d):
    return _graded(spark, d, True)


@query(f"WITH {PAIR} SELECT k, {R6('0.5 * avg(abs(p - y)) + 0.5 * (1 - covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p) + 1e-8))')} AS loss FROM pair GROUP BY k")
def loss_mae_corr(spark, d):
    return metrics.mae_corr_loss(_pair(spark, d), ["k"]).select("k", r6("loss").alias("loss"))


@query(f"SELECT l_orderkey AS k, {R6('avg(l_discount)')} AS mean, {R6('stddev_pop(l_discount)')} AS spread, count(DISTINCT l_linenumber) AS folds FROM lineitem GROUP BY l_orderkey")
def ensemble_mean(spark, d):
    return metrics.ensemble_mean(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("fold"), F.col("l_discount").alias("p")), ["k"]).select("k", r6("mean").alias("mean"), r6("spread").alias("spread"), "folds")


@query(f"WITH {RGB} SELECT k, t, {R6(f'(g - avg(g) {ALL}) / (stddev_pop(g) {ALL} + 1e-8) * (stddev_pop(r) {ALL} + 1e-8) + avg(r) {ALL}')} AS v FROM rgb")
def scale_modes(spark, d):
    w = whole("k")
    x = colour_traces(spark, d).select("k", "t", ((F.col("g") - F.avg("g").over(w)) / (F.stddev_pop("g").over(w) + 1e-8)).alias("v"), F.avg("r").over(w).alias("m"), F.stddev_pop("r").over(w).alias("s"))
    return _values(signal.destandardised(x, "v", "m", "s"))


def _subjects(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row"), F.col("c_nationkey").cast("long").alias("subject"), F.col("c_mktsegment").alias("trial"))


_SUBJECT = "(SELECT c_custkey AS \"row\", CAST(c_nationkey AS BIGINT) AS subject, c_mktsegment AS trial FROM customer)"


@query(f"SELECT \"row\", subject, dense_rank() OVER (ORDER BY subject) - 1 AS fold FROM {_SUBJECT}")
def fold_loso(spark, d):
    return splits.loso(_subjects(spark, d), "subject").select("row", "subject", "fold")


@query(f"SELECT \"row\", CAST(('0x' || substr(md5(CAST(\"row\" AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold FROM {_SUBJECT}")
def fold_kfold(spark, d):
    return splits.row_folds(_subjects(spark, d), "row", 5).select("row", "fold")


@query(f"SELECT \"row\", subject, (dense_rank() OVER (ORDER BY md5(CAST(subject AS VARCHAR)), subject) - 1) % 5 AS fold FROM {_SUBJECT}")
def fold_subject_kfold(spark, d):
    return splits.subject_folds(_subjects(spark, d), "subject", 5).select("row", "subject", "fold")


@query(f"WITH p AS (SELECT subject, trial, count(*) AS n_test FROM {_SUBJECT} GROUP BY ALL), q AS (SELECT *, CAST(sum(n_test) OVER (PARTITION BY subject) AS BIGINT) - n_test AS n_train FROM p) SELECT * FROM q WHERE n_train > 0")
def fold_within_loto(spark, d):
    return splits.leave_trial_out(_subjects(spark, d), "subject", "trial")


@query(f"""WITH r AS (SELECT "row", subject, dense_rank() OVER (ORDER BY md5(CAST(subject AS VARCHAR)), subject) - 1 AS place, (SELECT count(DISTINCT c_nationkey) FROM customer) AS n FROM {_SUBJECT})
SELECT "row", subject, CASE WHEN place < floor(n * 0.6 + 0.5) THEN 'train' WHEN place < floor(n * 0.6 + 0.5) + floor(n * 0.2 + 0.5) THEN 'val' ELSE 'test' END AS part FROM r""")
def split_602020(spark, d):
    return splits.three_way(_subjects(spark, d), "subject").select("row", "subject", "part")


# recurrences


@query(f"""WITH RECURSIVE {EV}, n AS (SELECT k, max(t) AS n, least(max(t), 12) AS more FROM ev GROUP BY k),
 p AS (SELECT ev.k, t - 1 AS i, n + more AS m, n, v AS p FROM ev JOIN n ON ev.k = n.k UNION ALL SELECT ev.k, t - 1 + more, n + more, n, v FROM ev JOIN n ON ev.k = n.k WHERE t > n - more),
 q AS MATERIALIZED (SELECT k, i, m, n, p, 1 + 5184.0::DOUBLE * (CAST(i <= m - 3 AS INT) + 4 * CAST(i BETWEEN 1 AND m - 2 AS INT) + CAST(i >= 2 AS INT)) AS main, -2 * 5184.0::DOUBLE * (CAST(i <= m - 3 AS INT) + CAST(i BETWEEN 1 AND m - 2 AS INT)) AS one, 5184.0::DOUBLE * CAST(i <= m - 3 AS INT) AS two FROM p),
 f AS (SELECT k, i, main AS d, one / main AS a, two / main AS b, p AS z, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS z1 FROM q WHERE i = 0
  UNION ALL SELECT k, i, d, (one - a0 * d0 * b0) / d, two / d, z, d0, b0, z0 FROM (SELECT q.k, q.i, one, two, f.a AS a0, f.b AS b0, f.d AS d0, f.z AS z0, main - f.a * f.a * f.d - f.b1 * f.b1 * f.d1 AS d, p - f.a * f.z - f.b1 * f.z1 AS z FROM f JOIN q ON q.k = f.k AND q.i = f.i + 1)),
 h AS MATERIALIZED (SELECT f.k, m - 1 - f.i AS j, z / d AS z, a, b FROM f JOIN (SELECT DISTINCT k, m FROM q) m ON f.k = m.k),
 g AS (SELECT k, j, z AS y, 0.0::DOUBLE AS y1 FROM h WHERE j = 0 UNION ALL SELECT h.k, h.j, h.z - h.a * g.y - h.b * g.y1, g.y FROM g JOIN h ON h.k = g.k AND h.j = g.j + 1)
SELECT q.k, i + 1 AS t, {R6('p - y')} AS v FROM q JOIN g ON g.k = q.k AND g.j = m - 1 - i WHERE i < n""")
def filt_detrend(spark, d):
    return _values(filters.apply_chain(event_signals(spark, d), [filters.detrend(6.0)]))


_CHROM = f"""{RGB}, xy AS (SELECT k, t, 3 * r - 2 * g AS x, 1.5 * r + g - 1.5 * b AS y FROM rgb), ev AS (SELECT k, t, -(x - stddev_pop(x) {ALL} / (stddev_pop(y) {ALL} + 1e-6) * y) AS v FROM xy), n AS (SELECT k, max(t) AS n FROM ev GROUP BY k)"""


def _both_ways(b, a) -> str:
    """A filter of second order forward and backward over each series, its ends reflected by nine samples, by recursion over the samples."""
    b, a = ([f"CAST({x!r} AS DOUBLE)" for x in map(float, c)] for c in (b, a))
    zero = f"(({b[1]} + {b[2]}) - ({a[1]} + {a[2]}) * {b[0]}) / (1 + {a[1]} + {a[2]})"
    one = f"({b[2]} - {a[2]} * {b[0]} - {a[2]} * ({zero}))"

    def through(name: str, source: str) -> str:
        return f"""{name} AS (SELECT k, j, {b[0]} * x + ({zero}) * x AS y, ({one}) * x + {b[1]} * x - {a[1]} * ({b[0]} * x + ({zero}) * x) AS s0, {b[2]} * x - {a[2]} * ({b[0]} * x + ({zero}) * x) AS s1 FROM {source} WHERE j = 0
 UNION ALL SELECT c.k, e.j, {b[0]} * x + s0, s1 + {b[1]} * x - {a[1]} * ({b[0]} * x + s0), {b[2]} * x - {a[2]} * ({b[0]} * x + s0) FROM {name} c JOIN {source} e ON e.k = c.k AND e.j = c.j + 1)"""

    return f"""ext AS MATERIALIZED (SELECT ev.k, t + 8 AS j, v AS x FROM ev UNION ALL SELECT f.k, 9 - (ev.t - 1), 2 * f.v - ev.v FROM ev JOIN ev f ON ev.k = f.k AND f.t = 1 WHERE ev.t BETWEEN 2 AND 10
 UNION ALL SELECT l.k, n + 8 + (n - ev.t), 2 * l.v - ev.v FROM ev JOIN n ON ev.k = n.k JOIN ev l ON l.k = n.k AND l.t = n.n WHERE ev.t BETWEEN n - 9 AND n - 1), {through('one', 'ext')},
 turned AS MATERIALIZED (SELECT one.k, n + 17 - j AS j, y AS x FROM one JOIN n ON one.k = n.k), {through('two', 'turned')}
 SELECT two.k, n + 9 - j AS t, {R6('y')} AS v FROM two JOIN n ON two.k = n.k WHERE j BETWEEN 9 AND n + 8"""


@query(f"WITH RECURSIVE {_CHROM}, {_both_ways(*filters._butterworth(1, 0.75, 3.0, 30.0))}")
def filt_bandpass(spark, d):
    return _values(filters.apply_chain(colour.chrom(colour_traces(spark, d)), [filters.bandpass(0.75, 3.0, 30.0)]))


_SG = ", ".join(f"({i}, {j}, CAST({float(w)!r} AS DOUBLE))" for i, row in enumerate(filters.smoothing(17, 5)) for j, w in enumerate(row))


@query(f"""WITH {_CHROM}, c(i, j, w) AS (VALUES {_SG}), p AS (SELECT ev.k, t, greatest(1, least(t - 8, n - 16)) AS a FROM ev JOIN n ON ev.k = n.k WHERE n >= 17)
SELECT p.k, p.t, {R6('sum(w * v)')} AS v FROM p JOIN c ON c.i = p.t - a JOIN ev ON ev.k = p.k AND ev.t = a + c.j GROUP BY p.k, p.t UNION ALL SELECT ev.k, t, {R6('v')} FROM ev JOIN n ON ev.k = n.k WHERE n < 17""")
def filt_sg(spark, d):
    return _values(filters.apply_chain(colour.chrom(colour_traces(spark, d)), [filters.savitzky_golay(30.0)]))


@query()
def filt_envelope(spark, d):
    return _values(filters.apply_chain(colour.chrom(colour_traces(spark, d)), [filters.bandpass(0.75, 3.0, 30.0), filters.by_envelope()]))


@query()
def filt_chain(spark, d):
    return _values(filters.apply_chain(colour.pos(colour_traces(spark, d)), [filters.detrend(30.0), filters.bandpass(0.75, 3.0, 30.0), filters.savitzky_golay(30.0)]))


@query()
def onsets(spark, d):
    return filters.onsets(filters.apply_chain(colour.chrom(colour_traces(spark, d)), [filters.bandpass(0.75, 3.0, 30.0)]), 30.0)


@query()
def dtw(spark, d):
    x = event_signals(spark, d)
    pairs = x.select("k", "t", zscore("v", whole("k")).alias("a")).withColumn("b", F.coalesce(F.lag("a").over(series("k", "t")), F.col("a")))
    return filters.pair_distances(pairs, 10).select("k", r6("dtw").alias("dtw"))
