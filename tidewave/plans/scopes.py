"""Registered queries of recordings, beats with margins, quality of waves, blocks of long series and polygons, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.functions.windows import series, whole
from tidewave.operators import beats, colour, filters, metrics, signal, studies, waves
from tidewave.plans.catalogue import _CHROM, _HB, _HG, _HR, _SG, BT, EV, ORACLE_SQL, R6, R9, RGB, _values, query, r6
from tidewave.plans.recursions import both_ways, detrended, spline, spline_through, strongest, unrounded, without_strongest
from tidewave.plans.shapes import _CHECK1, _PIXELS, _TURNS, _pixels
from tidewave.sources import layout, recordings
from tidewave.sources.tables import colour_traces, event_signals, recording_traces, table

#: Butterworth filters at 30 samples a second by the bilinear transform, forward (b) and back (a) weights.
BAND1 = ([0.19359960593003397, 0.0, -0.19359960593003397], [1.0, -1.5323732325771309, 0.612800788139932])  # first order, 0.75 to 3 Hz
BAND3 = ([0.009109513841753264, 0.0, -0.027328541525259792, 0.0, 0.027328541525259792, 0.0, -0.009109513841753264], [1.0, -4.809547082890498, 9.84778483709453, -11.011829868945606, 7.102549006081873, -2.5062702088808644, 0.37781126932260856])  # third order, 0.7 to 3 Hz
BAND5 = ([0.1402808497990749, 0.0, -0.7014042489953745, 0.0, 1.402808497990749, 0.0, -1.402808497990749, 0.0, 0.7014042489953745, 0.0, -0.1402808497990749], [1.0, -3.129411525331972, 2.9411038682635144, -0.7196842288564926, 0.8861399406654336, -1.5654908079247685, 0.3178342187893777, 0.2713004642398351, 0.08223529449609064, -0.06453601953480262, -0.019470205558553597])  # fifth order, 0.4 to 10 Hz
BANDP = ([0.7482021554936834, 0.0, -0.7482021554936834], [1.0, -0.472146914760073, -0.49640431098736687])  # first order, 0.1 to 12 Hz
LOW4 = ([0.02607772170109229, 0.10431088680436916, 0.15646633020655373, 0.10431088680436916, 0.02607772170109229], [1.0, -1.306605144101049, 1.0304538354195747, -0.3623690447688578, 0.05576390066780883])  # fourth order, up to 5 Hz

# recordings: series with a recording key, of several lengths and ranges

REC = RGB.replace("rgb AS", "rgb0 AS") + ", rgb AS (SELECT k % 3 AS rec, k, t, r / s AS r, g / s AS g, b / s AS b FROM (SELECT *, CASE WHEN k % 3 = 1 THEN 255.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM rgb0))"
_OWN = "OVER (PARTITION BY rec, k)"
_SHORT = f"ends AS (SELECT *, max(t) {_OWN} AS n FROM rgb), sh AS (SELECT rec, k, t, r, g, b FROM (SELECT *, min(n) OVER (PARTITION BY rec) AS m FROM ends) WHERE t <= m)"
_MEAN = f"nm AS (SELECT rec, k, t, r / (avg(r) {_OWN} + 1e-6) AS r, g / (avg(g) {_OWN} + 1e-6) AS g, b / (avg(b) {_OWN} + 1e-6) AS b FROM rgb)"


def _dense(source: str) -> str:
    return f"""dn AS (SELECT rec, k, t, {', '.join(f'-ln(least(greatest({c} / s, 1e-8), 1.0)) AS {c}' for c in 'rgb')} FROM (SELECT *, CASE WHEN max(greatest(r, g, b)) OVER (PARTITION BY rec) > 1.5 THEN 255.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM {source})),
 nr AS (SELECT 0.3570 * 0.6657 - 0.8372 * 0.6838 AS x, 0.8372 * 0.2988 - 0.4143 * 0.6657 AS y, 0.4143 * 0.6838 - 0.3570 * 0.2988 AS z),
 sf AS (SELECT rec, k, t, r - light AS r, g - light AS g, b - light AS b, CAST({_HR} AS DOUBLE) * r + CAST({_HG} AS DOUBLE) * g + CAST({_HB} AS DOUBLE) * b AS hemo FROM (SELECT dn.*, (CAST(nr.x AS DOUBLE) * r + CAST(nr.y AS DOUBLE) * g + CAST(nr.z AS DOUBLE) * b) / (CAST(nr.x + nr.y + nr.z AS DOUBLE) + 1e-8) AS light FROM dn, nr))"""


_GRAM = "sum(r * r) AS rr, sum(g * g) AS gg, sum(b * b) AS bb, sum(r * g) AS rg, sum(r * b) AS rb, sum(g * b) AS gb"


def _common(source: str, name: str) -> str:
    return f"""z AS MATERIALIZED (SELECT rec, k, t, {', '.join(f'({c} - avg({c}) {_OWN}) / (stddev_pop({c}) {_OWN} + 1e-8) AS {c}' for c in 'rgb')} FROM {source}), me AS (SELECT rec, t, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM z GROUP BY rec, t),
 gr AS MATERIALIZED (SELECT rec, {_GRAM} FROM me GROUP BY rec), {strongest('gr', 'rec')}, {name} AS MATERIALIZED (SELECT rec, k, t, g - eg * (er * r + eg * g + eb * b) AS v FROM z JOIN ei USING (rec))"""


def _told(df, *names):
    return df.select("rec", "k", "t", *(r6(c).alias(c) for c in names))


@query(f"WITH {REC}, {_SHORT} SELECT rec, k, t, {', '.join(f'{R6(c)} AS {c}' for c in 'rgb')} FROM sh")
def rgb_min_length_by_recording(spark, d):
    return _told(colour.to_shortest(recording_traces(spark, d), "rec"), "r", "g", "b")


@query(f"WITH {REC}, {_MEAN}, {_dense('nm')} SELECT rec, k, t, {R6(f'exp(-greatest(CAST({_HR} AS DOUBLE) * r + CAST({_HG} AS DOUBLE) * g + CAST({_HB} AS DOUBLE) * b, 0.0))')} AS v FROM dn")
def pulse_hemo_by_recording(spark, d):
    return _told(colour.hemo(recording_traces(spark, d), recording="rec"), "v")


@query(f"WITH {REC}, {_dense('rgb')} SELECT rec, k, t, {', '.join(f'{R6(c)} AS {c}' for c in ('r', 'g', 'b', 'hemo'))} FROM sf")
def pulse_skin_flat_by_recording(spark, d):
    return _told(colour.skin_flat(recording_traces(spark, d), recording="rec"), "r", "g", "b", "hemo")


@query(f"WITH {REC}, {_SHORT}, {_common('sh', 'lg')} SELECT rec, k, t, {R6('v')} AS v FROM lg")
def pulse_lgi_by_recording(spark, d):
    return _told(colour.lgi_global(colour.to_shortest(recording_traces(spark, d), "rec"), recording="rec"), "v")


@query(f"WITH RECURSIVE {REC}, {_SHORT}, {_dense('sh')}, {_common('sf', 'ev')}, {both_ways(*BAND3, keys='rec, k')} SELECT rec, k, t, {R6('v')} AS v FROM y")
def pulse_robust_by_recording(spark, d):
    return _told(colour.robust(colour.to_shortest(recording_traces(spark, d), "rec"), 30.0, recording="rec"), "v")


# strongest directions, for queries registered elsewhere

_TALL = RGB + ", top AS (SELECT min(n) AS n FROM (SELECT max(t) AS n FROM rgb GROUP BY k)), gl AS (SELECT 0 AS rec, k, t, r, g, b FROM rgb, top WHERE t <= n)"
_SKIN = _dense("gl").replace("OVER (PARTITION BY rec)", "OVER ()")
ORACLE_SQL["pulse_lgi"] = f"WITH {RGB}, gr AS MATERIALIZED (SELECT k, {_GRAM} FROM rgb GROUP BY k), {strongest('gr')} SELECT k, t, {R6('g - eg * (er * r + eg * g + eb * b)')} AS v FROM rgb JOIN ei USING (k)"
ORACLE_SQL["pulse_lgi_global"] = f"WITH {_TALL}, {_common('gl', 'lg')} SELECT k, t, {R6('v')} AS v FROM lg"
ORACLE_SQL["pulse_robust"] = f"WITH RECURSIVE {_TALL}, {_SKIN}, {_common('sf', 'ev')}, {both_ways(*BAND3)} SELECT k, t, {R6('v')} AS v FROM y"
_COVARIANCE = ", ".join(f"sum({a} * {b}) / (count(*) - 1) AS {a}{b}" for a, b in ("rr", "gg", "bb", "rg", "rb", "gb"))
_CENTRED = f"""ce AS MATERIALIZED (SELECT k, t, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY k) AS {c}' for c in 'rgb')} FROM rgb), gr AS MATERIALIZED (SELECT k, {_COVARIANCE} FROM ce GROUP BY k),
 {strongest('gr')}, g2 AS MATERIALIZED ({without_strongest('gr', 'ei')}), {strongest('g2', tag='b')}"""
ORACLE_SQL["pulse_pca"] = f"WITH {RGB}, {_CENTRED} SELECT k, t, {R6('er * r + eg * g + eb * b')} AS v FROM ce JOIN eib USING (k)"
ORACLE_SQL["pulse_pca_both"] = f"""WITH {RGB}, {_CENTRED}, bo AS (SELECT k, t, a.er * r + a.eg * g + a.eb * b AS v0, c.er * r + c.eg * g + c.eb * b AS v1 FROM ce JOIN ei a USING (k) JOIN eib c USING (k)),
 va AS (SELECT *, var_samp(v0) OVER (PARTITION BY k) AS s0, var_samp(v1) OVER (PARTITION BY k) AS s1 FROM bo) SELECT k, t, {R6('(s0 * v0 + s1 * v1) / (s0 + s1)')} AS v FROM va"""

# filters, for queries registered elsewhere

for _name, _taps, _digits in (("filt_lowpass", LOW4, 6), ("filt_bandpass3", BAND3, 6), ("filt_bandpass5", BAND5, 4), ("filt_bandpass", BAND1, 6)):
    ORACLE_SQL[_name] = f"WITH RECURSIVE {_CHROM.rsplit(', n AS', 1)[0]}, {both_ways(*_taps)} SELECT k, t, round(v, {_digits}) + 0.0 AS v FROM y"


# long series in blocks

_BLOCK, _HALO = 150, 60
_BLOCKS = f"bl AS MATERIALIZED (SELECT k, bn, v, t AS pl, row_number() OVER (PARTITION BY k, bn ORDER BY t) AS t FROM ev, range(0, 1000) b(bn) WHERE bn BETWEEN greatest((t - 1 - {_HALO}) // {_BLOCK}, 0) AND (t - 1 + {_HALO}) // {_BLOCK})"


@query(f"WITH RECURSIVE {_CHROM.rsplit(', n AS', 1)[0]}, {_BLOCKS}, {both_ways(*BAND1, source='bl', keys='k, bn')} SELECT k, pl AS t, {R6('y.v')} AS v FROM y JOIN bl USING (k, bn, t) WHERE (pl - 1) // {_BLOCK} = bn")
def filt_bandpass_blocks(spark, d):
    return _values(filters.apply_blocks(colour.chrom(colour_traces(spark, d)), [filters.bandpass(0.75, 3.0, 30.0)], _BLOCK, _HALO))


# onsets and the quality of waves


def _onsets(source: str, rate: int = 30) -> str:
    near, back, apart = int(0.2 * rate), int(0.4 * rate), int(0.3 * rate)
    return f"""sl AS MATERIALIZED (SELECT k, t, v, lead(v) OVER w AS nx, coalesce((lead(v) OVER w - lag(v) OVER w) / 2, lead(v) OVER w - v, v - lag(v) OVER w) AS g, max(t) OVER (PARTITION BY k) AS n FROM {source} WINDOW w AS (PARTITION BY k ORDER BY t)),
 zc AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS nth FROM (SELECT k, t, v, nx, n, arg_max(v, row(g, -t)) OVER s AS vt, arg_max(t, row(g, -t)) OVER s AS tt, max(g) OVER s AS gt, min(v) OVER (PARTITION BY k ORDER BY t ROWS {back} PRECEDING) AS low FROM sl WINDOW s AS (PARTITION BY k ORDER BY t ROWS BETWEEN {near} PRECEDING AND {near} FOLLOWING)) WHERE v < 0 AND nx >= 0 AND gt * {rate} > 1e-6),
 ft AS MATERIALIZED (SELECT k, nth, greatest(0, least(n - 1, CAST(round_even(tt - 1 + (low - vt) / gt, 0) AS BIGINT))) + 1 AS foot FROM zc),
 gy AS (SELECT k, nth, foot, foot AS last, true AS kept FROM ft WHERE nth = 1 UNION ALL SELECT f.k, f.nth, f.foot, CASE WHEN f.foot - g.last >= {apart} THEN f.foot ELSE g.last END, f.foot - g.last >= {apart} FROM gy g JOIN ft f ON f.k = g.k AND f.nth = g.nth + 1),
 ons AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY nth) AS beat, foot AS t FROM gy WHERE kept)"""


ORACLE_SQL["onsets"] = f"WITH RECURSIVE {_CHROM.rsplit(', n AS', 1)[0]}, {both_ways(*BAND1)}, {_onsets('y')} SELECT k, beat, t FROM ons"

_GRADIENT = "coalesce((lead({0}) OVER w - lag({0}) OVER w) / 2, lead({0}) OVER w - {0}, {0} - lag({0}) OVER w)"
_QUALITY = f"""WITH RECURSIVE {_CHROM.rsplit(', n AS', 1)[0]}, {both_ways(*BAND5)}, {_onsets('y')},
 sg AS MATERIALIZED (SELECT y.k, beat, ons.t AS t0, nt AS t1, y.t - ons.t AS j, v FROM y JOIN (SELECT *, lead(t) OVER (PARTITION BY k ORDER BY beat) AS nt FROM ons) ons ON y.k = ons.k AND y.t >= ons.t AND y.t < nt), {spline(30, 'sg', 'k, beat', 's')},
 g1 AS (SELECT k, beat, i, {_GRADIENT.format('v')} AS v FROM sps WINDOW w AS (PARTITION BY k, beat ORDER BY i)), g2 AS MATERIALIZED (SELECT k, beat, i, {_GRADIENT.format('v')} AS v FROM g1 WINDOW w AS (PARTITION BY k, beat ORDER BY i)),
 q AS (SELECT a.k, a.beat, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS sqi FROM g2 a JOIN g2 b ON a.k = b.k AND b.beat = a.beat + 1 AND a.i = b.i GROUP BY a.k, a.beat),
 ta AS MATERIALIZED (SELECT s.k, s.beat, (t0 - 1) / 30.0::DOUBLE AS b0, (t1 - 1) / 30.0::DOUBLE AS b1, sqi, coalesce(sqi >= 0.3, false) AS good FROM (SELECT DISTINCT k, beat, t0, t1 FROM sg) s LEFT JOIN q ON q.k = s.k AND q.beat = s.beat)"""


def _quality(spark, d):
    return beats.waveform_quality(colour.chrom(colour_traces(spark, d)), 30.0)


@query(f'{_QUALITY} SELECT k, beat, {R6("b0")} AS "start", {R6("b1")} AS "end", {R6("sqi")} AS sqi, good FROM ta')
def waveform_quality(spark, d):
    return _quality(spark, d).select("k", "beat", r6("start").alias("start"), r6("end").alias("end"), r6("sqi").alias("sqi"), "good")


@query(f"""{_QUALITY}, rn AS (SELECT *, beat - row_number() OVER (PARTITION BY k ORDER BY beat) AS run FROM ta WHERE good) SELECT k, {R6('min(b0)')} AS "start", {R6('max(b1)')} AS "end" FROM rn GROUP BY k, run""")
def waveform_good_times(spark, d):
    return beats.good_times(_quality(spark, d)).select("k", r6("start").alias("start"), r6("end").alias("end"))


# beats with a margin before their valley

_MARGIN, _REACH = 4, 8
_SOFT = f"{RGB}, ev AS (SELECT k, t, avg(g) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM rgb)"
_CUT = f"""low AS (SELECT *, coalesce(v < min(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN {_REACH} PRECEDING AND 1 PRECEDING) AND v < min(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {_REACH} FOLLOWING), false) AS valley FROM ev),
 va AS (SELECT k, t AS a, lead(t) OVER (PARTITION BY k ORDER BY t) AS z, row_number() OVER (PARTITION BY k ORDER BY t) AS beat FROM low WHERE valley),
 bm AS MATERIALIZED (SELECT ev.k, CAST(beat AS BIGINT) AS beat, ev.t - a + {_MARGIN} AS pos, z - a + {_MARGIN} AS n, v FROM ev JOIN va ON ev.k = va.k AND ev.t >= a - {_MARGIN} AND ev.t < z WHERE a > {_MARGIN})"""
_FLAT = f"""mv AS (SELECT *, max(v) FILTER (WHERE pos = {_MARGIN}) OVER b AS f, arg_max(v, pos) OVER b AS l FROM bm WINDOW b AS (PARTITION BY k, beat)), mf AS (SELECT k, beat, pos, CASE WHEN pos < {_MARGIN} THEN v ELSE v - (f + (l - f) * (pos - {_MARGIN}) / greatest(n - 1 - {_MARGIN}, 1)) END AS v FROM mv),
 md AS (SELECT * FROM (SELECT k, beat, pos, round((lead(v, 2) OVER w - lead(v) OVER w) - (lead(v) OVER w - v), 6) AS v FROM mf WINDOW w AS (PARTITION BY k, beat ORDER BY pos)) WHERE v IS NOT NULL)"""
_STATS = f"""{_TURNS.format('md')}, p5 AS (SELECT * FROM (SELECT *, row_number() OVER w AS nth, pos - lag(pos) OVER w AS gap FROM tn WINDOW w AS (PARTITION BY k, beat ORDER BY pos)) WHERE nth <= 5),
 t5 AS (SELECT k, beat, count(*) AS turns, max(v) AS top, min(v) AS bottom, min(gap) AS gap, max(v) FILTER (WHERE nth = 1) AS a, max(v) FILTER (WHERE nth = 2) AS b FROM p5 GROUP BY k, beat),
 st AS (SELECT o.k, o.beat, area, duration, amplitude, coalesce(turns = 5 AND a = top AND b = bottom AND gap >= 0.03 * sz.n, false) AS good FROM (SELECT k, beat, sum(v) AS area, count(*) AS duration, max(v) AS amplitude FROM bm WHERE pos >= {_MARGIN} GROUP BY k, beat) o LEFT JOIN sz ON sz.k = o.k AND sz.beat = o.beat LEFT JOIN t5 ON t5.k = o.k AND t5.beat = o.beat)"""


def _soft_beats(spark, d):
    soft = F.avg("g").over(series("k", "t").rowsBetween(-3, 3))
    return beats.cut_with_margin(colour_traces(spark, d).select("k", "t", soft.alias("v")), _REACH, _MARGIN)


@query(f"WITH {_SOFT}, {_CUT} SELECT k, beat, pos, {R9('v')} AS v FROM bm")
def beat_margins(spark, d):
    return _soft_beats(spark, d).select("k", "beat", "pos", r6("v", 9).alias("v"))


@query(f"WITH {_SOFT}, {_CUT}, {_FLAT}, {_STATS} SELECT k, beat, {R6('area')} AS area, duration, {R6('amplitude')} AS amplitude, good FROM st")
def beat_margin_stats(spark, d):
    return beats.margin_statistics(_soft_beats(spark, d), _MARGIN).select("k", "beat", r6("area").alias("area"), "duration", r6("amplitude").alias("amplitude"), "good")


_NEAR = " AND ".join(f"round(abs({c} - avg({c}) OVER (PARTITION BY k)), 9) <= round(stddev_pop({c}) OVER (PARTITION BY k), 9)" for c in ("area", "duration", "amplitude"))


@query(f"""WITH RECURSIVE {_SOFT}, {_CUT}, {_FLAT}, {_STATS}, ch AS (SELECT k, beat, amplitude FROM (SELECT *, {_NEAR} AS near FROM st) WHERE near),
 sc AS MATERIALIZED (SELECT bm.k, bm.beat, pos AS j, v / amplitude AS v FROM bm JOIN ch ON bm.k = ch.k AND bm.beat = ch.beat), {spline(60, 'sc', 'k, beat', 'm')}, av AS MATERIALIZED (SELECT k, i, avg(v) AS v FROM spm GROUP BY k, i),
 fv AS (SELECT k, coalesce(min(i) FILTER (WHERE v < p AND v < q), 0) AS a0 FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY i) AS p, lead(v) OVER (PARTITION BY k ORDER BY i) AS q FROM av) GROUP BY k),
 en AS (SELECT av.k, i, v, a0, max(v) FILTER (WHERE i = a0) OVER (PARTITION BY av.k) AS f, arg_max(v, i) OVER (PARTITION BY av.k) AS l FROM av JOIN fv ON fv.k = av.k),
 co AS (SELECT k, i, CASE WHEN i < a0 THEN v ELSE v - (f + (l - f) * (i - a0) / greatest(59 - a0, 1)) + f END AS v FROM en)
SELECT k, i AS pos, {R6('CASE WHEN max(v) OVER (PARTITION BY k) - min(v) OVER (PARTITION BY k) <= 1e-8 THEN 0 ELSE (v - min(v) OVER (PARTITION BY k)) / (max(v) OVER (PARTITION BY k) - min(v) OVER (PARTITION BY k)) * 2 END')} AS v FROM co""")
def beat_t1_margin(spark, d):
    x = _soft_beats(spark, d)
    chosen = beats.usual(beats.margin_statistics(x, _MARGIN))
    return beats.representative_with_margin(x, chosen, 60, _MARGIN).select("k", "pos", r6("v").alias("v"))


# polygons

_POLYGONS = [("brow", [(2, 1), (9, 3), (7, 9), (1, 7)]), ("nose", [(10, 4), (15, 14), (12, 9), (8, 14)]), ("line", [(3, 15), (12, 15)])]


def _corners(spark, d):
    """Each region's polygon, moved by the frame's number."""
    frames = _pixels(spark, d).select("frame").distinct()
    shapes = F.array(*[F.struct(F.lit(roi).alias("roi"), F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")) for roi, c in _POLYGONS for i, (x, y) in enumerate(c)])
    rows = frames.select("frame", F.explode(shapes).alias("c"))
    return rows.select("frame", "c.roi", "c.i", (F.col("c.x") + F.col("frame") % 4).cast("long").alias("x"), F.col("c.y").cast("long").alias("y"))


_CORNERS = ", ".join(f"('{roi}', {i}, {x}, {y}, {c[(i + 1) % len(c)][0]}, {c[(i + 1) % len(c)][1]})" for roi, c in _POLYGONS for i, (x, y) in enumerate(c))


@query(f"""WITH {_PIXELS}, ed(roi, i, x1, y1, x2, y2) AS (VALUES {_CORNERS}), pt AS (SELECT DISTINCT frame, x, y, x - frame % 4 AS px FROM px),
 hit AS (SELECT frame, x, y, roi, sum(CASE WHEN (y1 <= y) <> (y2 <= y) AND px < x1 + (y - y1) * (x2 - x1) / (y2 - y1)::DOUBLE THEN 1 ELSE 0 END) % 2 = 1
  OR bool_or((x2 - x1) * (y - y1) = (y2 - y1) * (px - x1) AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS inside FROM pt, ed GROUP BY ALL)
SELECT frame, roi, count(*) AS pixels, {', '.join(f"{R9(f'avg({c})')} AS {c}" for c in 'rgb')} FROM px JOIN hit USING (frame, x, y) WHERE inside GROUP BY frame, roi""")
def roi_polygon_means(spark, d):
    return colour.polygon_means(_pixels(spark, d), _corners(spark, d)).select("frame", "roi", "pixels", *(r6(c, 9).alias(c) for c in "rgb"))

# chains and splines, for queries registered elsewhere

_POS = f"ev AS MATERIALIZED ({unrounded(ORACLE_SQL['pulse_pos'])})"
ORACLE_SQL["filt_chain"] = f"""WITH RECURSIVE {_POS}, {detrended(30, 'ev')}, {both_ways(*BAND1, source='dt')}, c(i, j, w) AS (VALUES {_SG}), p AS (SELECT k, t, v, greatest(1, least(t - 8, n - 16)) AS a FROM y JOIN n USING (k) WHERE n >= 17)
SELECT p.k, p.t, {R6('sum(w * y.v)')} AS v FROM p JOIN c ON c.i = p.t - a JOIN y ON y.k = p.k AND y.t = a + c.j GROUP BY p.k, p.t"""
_ONE = _CHROM.rsplit(', n AS', 1)[0]
_HILBERT = """h AS (SELECT a.k, a.t, max(a.v) AS v, sum(CASE WHEN (a.t - b.t) % 2 = 0 AND n % 2 = 0 OR a.t = b.t THEN 0 WHEN n % 2 = 0 THEN b.v * 2 / n / tan(pi() * (a.t - b.t) / n) ELSE b.v / n * (cos(pi() * (a.t - b.t) / n) - CASE WHEN (a.t - b.t) % 2 = 0 THEN 1 ELSE -1 END) / sin(pi() * (a.t - b.t) / n) END) AS q FROM y a JOIN y b ON a.k = b.k JOIN n ON n.k = a.k GROUP BY a.k, a.t)"""
ORACLE_SQL["filt_envelope"] = f"""WITH RECURSIVE {_ONE}, {both_ways(*BAND1)}, {_HILBERT} SELECT k, t, {R6('v / CASE WHEN v * v + q * q = 0 THEN 1e-8 ELSE sqrt(v * v + q * q) END')} AS v FROM h"""
_RESAMPLED = unrounded(ORACLE_SQL["sig_resample_poly"]).replace(EV, f"{RGB}, ev AS (SELECT k, t, -g AS v FROM rgb)")
ORACLE_SQL["ppg_preprocess"] = f"WITH RECURSIVE rs AS MATERIALIZED (SELECT k, i + 1 AS t, v FROM ({_RESAMPLED})), {detrended(30, 'rs')}, {both_ways(*BANDP, source='dt')} SELECT k, t - 1 AS t, {R6('-v')} AS v FROM y"
ORACLE_SQL["sig_upsample_cubic"] = f"WITH RECURSIVE {EV}, sr AS (SELECT k, t - 1 AS j, v FROM ev), {spline(120, 'sr')} SELECT k, i, {R6('v')} AS v FROM sp"
ORACLE_SQL["sig_normal_pulse"] = f"""WITH RECURSIVE {BT}, sr AS (SELECT k, beat, pos AS j, v FROM bt), {spline(100, 'sr', 'k, beat')}, f AS (SELECT k, beat, i, abs(v - (first_value(v) OVER w + (last_value(v) OVER w - first_value(v) OVER w) * i / 99)) AS v FROM sp WINDOW w AS (PARTITION BY k, beat ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 p AS (SELECT *, max(v) OVER w AS top, arg_max(i, row(v, -i)) OVER w AS peak FROM f WINDOW w AS (PARTITION BY k, beat)) SELECT k, beat, i, {R6('CASE WHEN top > 0 THEN v / top ELSE v END')} AS v, peak, peak <= 60 AS usable FROM p"""
_SUMS = "(SELECT k, beat, sum(v) AS area, count(*) AS duration, max(v) AS amplitude FROM (SELECT k, beat, v - (first_value(v) OVER a + (last_value(v) OVER a - first_value(v) OVER a) * pos / greatest(count(*) OVER a - 1, 1)) AS v FROM bt WINDOW a AS (PARTITION BY k, beat ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY k, beat)"
ORACLE_SQL["beat_representative"] = f"""WITH RECURSIVE {BT}, ch AS (SELECT k, beat FROM (SELECT k, beat, {_NEAR} AS near FROM {_SUMS}) WHERE near), sc AS (SELECT k, beat, pos AS j, v / max(v) OVER (PARTITION BY k, beat) AS v FROM bt JOIN ch USING (k, beat)), {spline(100, 'sc', 'k, beat')}, av AS (SELECT k, i, avg(v) AS v FROM sp GROUP BY k, i),
 fl AS (SELECT k, i, v - (first_value(v) OVER w + (last_value(v) OVER w - first_value(v) OVER w) * i / 99) AS v FROM av WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT k, i AS pos, {R6('CASE WHEN max(v) OVER (PARTITION BY k) - min(v) OVER (PARTITION BY k) <= 1e-8 THEN 0 ELSE (v - min(v) OVER (PARTITION BY k)) / (max(v) OVER (PARTITION BY k) - min(v) OVER (PARTITION BY k)) * 2 END')} AS v FROM fl"""


# warping distances, by recursion over the anti-diagonals of all pairs


def _warping(pairs: str, reach: int) -> str:
    cell = f"CASE WHEN i < 1 OR i > n OR d + 1 - i < 1 OR d + 1 - i > n OR abs(2 * i - d - 1) > {reach} THEN 'inf'::DOUBLE ELSE (a[i] - b[d + 1 - i]) * (a[i] - b[d + 1 - i]) + least(one[i], one[i + 1], two[i]) END"
    return f"""pk AS MATERIALIZED (SELECT k, count(*) AS n, list(a ORDER BY t) AS a, list(b ORDER BY t) AS b FROM {pairs} GROUP BY k),
 dg AS (SELECT k, n, a, b, 0 AS d, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS one, list_transform(range(0, n + 1), lambda i: 'inf'::DOUBLE) AS two FROM pk
  UNION ALL SELECT k, n, a, b, d + 1, list_transform(range(0, n + 1), lambda i: {cell}), one FROM dg WHERE d < 2 * n)
SELECT k, {R6('sqrt(one[n + 1])')} AS dtw FROM dg WHERE d = 2 * n"""


_LAGGED = f"{EV}, z AS (SELECT k, t, CASE WHEN stddev_pop(v) OVER (PARTITION BY k) < 1e-8 THEN 0 ELSE (v - avg(v) OVER (PARTITION BY k)) / (stddev_pop(v) OVER (PARTITION BY k) + 1e-8) END AS a FROM ev), pr AS (SELECT k, t, a, coalesce(lag(a) OVER (PARTITION BY k ORDER BY t), a) AS b FROM z)"
ORACLE_SQL["dtw"] = f"WITH RECURSIVE {_LAGGED}, {_warping('pr', 10)}"


@query(f"WITH RECURSIVE {RGB}, {EV}, jo AS (SELECT rgb.k, rgb.t, g, v FROM rgb JOIN ev ON rgb.k = ev.k AND rgb.t = ev.t), pr AS (SELECT k, t, {', '.join(f'({c} - avg({c}) OVER (PARTITION BY k)) / (stddev_pop({c}) OVER (PARTITION BY k) + 1e-8) AS {n}' for c, n in (('g', 'a'), ('v', 'b')))} FROM jo), {_warping('pr', 12)}")
def dtw_two_sources(spark, d):
    """A region's green trace against its subject's reference signal."""
    both = colour_traces(spark, d).join(event_signals(spark, d).select("k", "t", "v"), ["k", "t"])
    w = whole("k")
    scaled = [((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-8)).alias(n) for c, n in (("g", "a"), ("v", "b"))]
    return filters.pair_distances(both.select("k", "t", *scaled), 12).select("k", r6("dtw").alias("dtw"))


# tables of a study

_VALLEYS = f"""low AS (SELECT *, coalesce(v < min(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AND v < min(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), false) AS valley FROM ev),
 va AS (SELECT k, t AS a, lead(t) OVER (PARTITION BY k ORDER BY t) AS z, row_number() OVER (PARTITION BY k ORDER BY t) AS beat FROM low WHERE valley),
 sb AS MATERIALIZED (SELECT ev.k, CAST(beat AS BIGINT) AS beat, ev.t - a AS pos, a, z, z - a AS n, v FROM ev JOIN va ON ev.k = va.k AND ev.t >= a AND ev.t < z)"""
_ALIKE = """SELECT x.k, x.beat, covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0) AS sqi FROM {0} x JOIN {0} y ON x.k = y.k AND y.beat = x.beat + 1 AND x.i = y.i GROUP BY x.k, x.beat"""
_SEGMENTS = f"""{_VALLEYS}, sj AS (SELECT k, beat, pos AS j, v FROM sb), {spline(50, 'sj', 'k, beat', 'q')}, d1 AS (SELECT k, beat, i, {_GRADIENT.format('v')} AS v FROM spq WINDOW w AS (PARTITION BY k, beat ORDER BY i)), d2 AS MATERIALIZED (SELECT k, beat, i, {_GRADIENT.format('v')} AS v FROM d1 WINDOW w AS (PARTITION BY k, beat ORDER BY i)),
 q0 AS ({_ALIKE.format('spq')}), q2 AS ({_ALIKE.format('d2')}), ch AS (SELECT k, beat, pos, v - (first_value(v) OVER w + (last_value(v) OVER w - first_value(v) OVER w) * pos / greatest(n - 1, 1)) AS v FROM sb WINDOW w AS (PARTITION BY k, beat ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 {_TURNS.format('ch')}, {_CHECK1}, st AS (SELECT k, beat, max(a) AS a, max(z) AS z, sum(v) AS area, count(*) AS duration, max(v) AS amplitude FROM sb GROUP BY k, beat), us AS (SELECT *, {_NEAR} AS near FROM st),
 sm AS MATERIALIZED (SELECT us.k, us.beat, (a - 1) / 30.0::DOUBLE AS b0, (z - 1) / 30.0::DOUBLE AS b1, duration AS n, q0.sqi AS sqi_wave, q2.sqi AS sqi, coalesce(q0.sqi >= 0.3 AND q2.sqi >= 0.3, false) AS quality, good AS accepted_ppg, near AS accepted_area FROM us LEFT JOIN q0 ON q0.k = us.k AND q0.beat = us.beat LEFT JOIN q2 ON q2.k = us.k AND q2.beat = us.beat LEFT JOIN ok1 ON ok1.k = us.k AND ok1.beat = us.beat)"""
_WAVE = f"""{_CHROM.rsplit(', n AS', 1)[0].replace(' ev AS (', ' tr AS (')}, {both_ways(*BAND1, source='tr')}, ev AS MATERIALIZED (SELECT * FROM y)"""


def _study(spark, d):
    return filters.apply_chain(colour.chrom(colour_traces(spark, d)), [filters.bandpass(0.75, 3.0, 30.0)])


@query(f"""WITH RECURSIVE {_WAVE}, {_SEGMENTS} SELECT k, beat, {R6('b0')} AS "start", {R6('b1')} AS "end", n, {R6('sqi_wave')} AS sqi_wave, {R6('sqi')} AS sqi, quality, accepted_ppg, accepted_area FROM sm""")
def study_segments(spark, d):
    told = studies.segments(_study(spark, d), 30.0, 12)
    return told.select("k", "beat", r6("start").alias("start"), r6("end").alias("end"), "n", r6("sqi_wave").alias("sqi_wave"), r6("sqi").alias("sqi"), "quality", "accepted_ppg", "accepted_area")


_RESIZED = """nx AS (SELECT sb.*, lead(v) OVER (PARTITION BY sb.k, sb.beat ORDER BY pos) AS nv FROM sb JOIN sm ON sb.k = sm.k AND sb.beat = sm.beat WHERE quality AND sb.n >= 5), rz AS (SELECT k, beat, i AS pos, v + (coalesce(nv, v) - v) * (i * (n - 1) / 119.0::DOUBLE - pos) AS v FROM nx JOIN range(120) g(i) ON pos = (i * (n - 1)) // 119),
 bt AS MATERIALIZED (SELECT k, beat, pos, v - (first_value(v) OVER w + (last_value(v) OVER w - first_value(v) OVER w) * pos / 119) AS v FROM rz WINDOW w AS (PARTITION BY k, beat ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_CN = ["t1", "t2", "t_sub", "t_div", "systolic", "diastolic", "area_ratio", "slope_up", "slope_down", *(f"width{p}" for p in beats.LEVELS)]


@query(f"WITH RECURSIVE {_WAVE}, {_SEGMENTS}, {_RESIZED} SELECT k, beat, {', '.join(f'{c} AS cn_{c}' for c in _CN)} FROM ({ORACLE_SQL['beat_contour'].replace('WITH ' + BT + ',', 'WITH')})")
def study_beat_contours(spark, d):
    x = _study(spark, d)
    told = studies.beat_contours(x, studies.marked_beats(x, 30.0, 12).where("quality"), 12, 120)[1]
    whole_numbers = [c for c in _CN if c in ("t1", "t2", "t_sub") or c.startswith("width")]
    return told.select("k", "beat", *(F.col(f"cn_{c}") if c in whole_numbers else r6(f"cn_{c}").alias(f"cn_{c}") for c in _CN))


@query()
def study_features(spark, d):
    mean, _, _ = studies.study_features(_study(spark, d), 30.0, 12, 120)
    return mean.select("k", "beats", *(r6(c, 4).alias(c) for c in ("cn_t1", "cn_t_div", "cn_systolic_share", "cn_width50", "dr_ageing", "dr_b_a", "dr_v_top")))


# splines through uneven times

_TIMES = f"{EV}, tm AS (SELECT k, (t + t % 3) / 6.0::DOUBLE AS x, v FROM ev), kn AS MATERIALIZED (SELECT k, x, v, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS j FROM (SELECT k, x, min(v) AS v FROM tm GROUP BY k, x))"


def _grid(first: str, last: str, rate: str) -> str:
    return f"gs AS (SELECT k, {first} AS f, {last} AS l, CAST(floor({rate} * (({last}) - ({first}))) AS BIGINT) AS m FROM kn GROUP BY k), gr AS MATERIALIZED (SELECT k, i, CASE WHEN m > 1 THEN f + (l - f) * (i / (m - 1)::DOUBLE) ELSE f END AS x FROM gs, range(0, 10000) r(i) WHERE i < m)"


ORACLE_SQL["sig_at_times"] = f"WITH RECURSIVE {_TIMES}, {_grid('min(x)', 'max(x)', '4.0::DOUBLE')}, {spline_through('kn', 'gr')} SELECT k, i, {R6('v')} AS v FROM sq"


@query(f"WITH RECURSIVE {_TIMES}, {_grid('floor(min(x)) + 1', 'floor(max(x))', '4.0::DOUBLE')}, {spline_through('kn', 'gr')} SELECT k, i, {R6('v')} AS v FROM sq")
def sig_at_whole_seconds(spark, d):
    x = event_signals(spark, d).select("k", ((F.col("t") + F.col("t") % 3) / 6.0).alias("sec"), "v")
    return waves.at_times(x, "sec", 4.0, True, 1.0).select("k", "i", r6("v").alias("v"))


@query(f"WITH RECURSIVE {_ONE}, {both_ways(*BAND1)}, {_HILBERT} SELECT k, t - 1 AS i, {R6('v / CASE WHEN e = 0 THEN 1e-8 ELSE e END')} AS v, {R6('CASE WHEN e = 0 THEN 1e-8 ELSE e END')} AS envelope FROM (SELECT *, sqrt(v * v + q * q) AS e FROM h)")
def filt_over_envelope(spark, d):
    return waves.over_envelope(_study(spark, d)).select("k", "i", r6("v").alias("v"), r6("envelope").alias("envelope"))


@query(f"""WITH ev0 AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS v FROM events), ev AS (SELECT k, t, CASE WHEN t % 17 = 1 THEN v + 100000 ELSE v END AS v FROM ev0),
 qu AS (SELECT k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM ev GROUP BY k), hole AS (SELECT ev.k, t, CASE WHEN v BETWEEN a - 3 * (b - a) AND b + 3 * (b - a) THEN v END AS v FROM ev JOIN qu ON ev.k = qu.k),
 g AS (SELECT *, min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY k) AS a, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY k) AS b FROM hole),
 h AS (SELECT *, avg(CASE WHEN t > a AND t <= a + 4 THEN v END) OVER (PARTITION BY k) AS head, avg(CASE WHEN t < b AND t >= b - 4 THEN v END) OVER (PARTITION BY k) AS tail,
 last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t) AS t0, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t) AS v0,
 first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1,
 first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM g)
SELECT k, t, {R6('CASE WHEN t < a THEN head WHEN t > b THEN tail ELSE coalesce(v, v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0)) END')} AS v FROM h""")
def sig_outliers_filled(spark, d):
    x = event_signals(spark, d).select("k", "t", F.when(F.col("t") % 17 == 1, F.col("v") + 100000).otherwise(F.col("v")).alias("v"))
    return _values(signal.outliers_filled(x))


# scores of predictions in both scales

_STEPS = "CASE WHEN one[i] <= one[i + 1] AND one[i] <= two[i] THEN 1 + s1[i] WHEN one[i + 1] <= two[i] THEN 1 + s1[i + 1] ELSE 1 + s2[i] END"


def _paths(pairs: str, reach: int, tag: str) -> str:
    """CTEs that end in `wp{tag}` (k, dtw): warping distances over the steps of the path."""
    cell = f"CASE WHEN i < 1 OR i > n OR d + 1 - i < 1 OR d + 1 - i > n OR abs(2 * i - d - 1) > {reach} THEN 'inf'::DOUBLE ELSE (a[i] - b[d + 1 - i]) * (a[i] - b[d + 1 - i]) + least(one[i], one[i + 1], two[i]) END"
    start = lambda zero, other: f"list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN {zero} ELSE {other} END)"
    return f"""pk{tag} AS MATERIALIZED (SELECT k, count(*) AS n, list(a ORDER BY t) AS a, list(b ORDER BY t) AS b FROM {pairs} GROUP BY k),
 dg{tag} AS (SELECT k, n, a, b, 0 AS d, {start("0.0::DOUBLE", "'inf'::DOUBLE")} AS one, {start("'inf'::DOUBLE", "'inf'::DOUBLE")} AS two, {start("0", "0")} AS s1, {start("0", "0")} AS s2 FROM pk{tag}
  UNION ALL SELECT k, n, a, b, d + 1, list_transform(range(0, n + 1), lambda i: {cell}), one, list_transform(range(0, n + 1), lambda i: CASE WHEN i < 1 THEN 0 ELSE {_STEPS} END), s1 FROM dg{tag} WHERE d < 2 * n),
 wp{tag} AS (SELECT k, sqrt(one[n + 1] / greatest(s1[n + 1], 1)) AS dtw FROM dg{tag} WHERE d = 2 * n)"""


_SCORED = f"""{RGB}, {EV}, jo AS (SELECT rgb.k, rgb.t, v AS y, (g - avg(g) OVER w) / (stddev_pop(g) OVER w + 1e-8) AS p FROM rgb JOIN ev ON rgb.k = ev.k AND rgb.t = ev.t WINDOW w AS (PARTITION BY rgb.k)),
 bo AS MATERIALIZED (SELECT k, t, y, p, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-8) AS z, p * (stddev_pop(y) OVER w + 1e-8) + avg(y) OVER w AS q FROM jo WINDOW w AS (PARTITION BY k)),
 zq AS MATERIALIZED (SELECT k, t, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-8) AS a, (q - avg(q) OVER w) / (stddev_pop(q) OVER w + 1e-8) AS b FROM bo WINDOW w AS (PARTITION BY k)), zp AS (SELECT k, t, z AS a, p AS b FROM bo)"""


@query(f"""WITH RECURSIVE {_SCORED}, {_paths('zp', 10, '1')}, {_paths('zq', 10, '2')},
 er AS (SELECT k, count(*) AS n, covar_pop(z, p) / (stddev_pop(z) * stddev_pop(p) + 1e-12) AS r_std, sqrt(avg((p - z) * (p - z))) AS rmse_std, covar_pop(y, q) / (stddev_pop(y) * stddev_pop(q) + 1e-12) AS r, sqrt(avg((q - y) * (q - y))) AS rmse FROM bo GROUP BY k)
SELECT k, n, {R6('r_std')} AS r_std, {R6('rmse_std')} AS rmse_std, {R6('a.dtw')} AS dtw_std, {R6('r')} AS r, {R6('rmse')} AS rmse, {R6('b.dtw')} AS dtw FROM er JOIN wp1 a USING (k) JOIN wp2 b USING (k)""")
def eval_both_scales(spark, d):
    """A standardised trace as the prediction of its subject's reference signal."""
    both = colour_traces(spark, d).join(event_signals(spark, d).select("k", "t", F.col("v").alias("y")), ["k", "t"])
    w = whole("k")
    guess = both.select("k", "t", "y", ((F.col("g") - F.avg("g").over(w)) / (F.stddev_pop("g").over(w) + 1e-8)).alias("p"))
    told = metrics.both_scales(guess, window=10)
    return told.select("k", "n", *(r6(c).alias(c) for c in ("r_std", "rmse_std", "dtw_std", "r", "rmse", "dtw")))


# layouts of files, on paths made of the tables' names

_FLAT_PATHS = "SELECT 'study/' || (['CHROM', 'LGI', 'POS'])[1 + s_suppkey % 3] || '/' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '_Before_' ELSE '_after_' END || CASE WHEN s_suppkey % 5 = 0 THEN '12' ELSE lower(substr(n_name, 1, 5)) END || '.csv' AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_DEEP_PATHS = """SELECT lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '/video/images-' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '_FullHDwebcam_' || CASE WHEN s_suppkey % 7 = 0 THEN 'after' ELSE 'before' END || '/rPPG-pulse/' || m || '/' || r || '/bandpass_pulse.csv' AS path
 FROM supplier, (SELECT unnest(['CHROM', 'LGI', 'GREEN']) AS m), (SELECT unnest(['roi_3', 'Left-Cheek', 'chin']) AS r) WHERE (s_suppkey + length(m) + length(r)) % 4 <> 0 UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '/' || CASE WHEN s_suppkey % 2 = 0 THEN 'b' ELSE 'a' END || '_PPG_' || x || '.csv' FROM supplier, (SELECT unnest(['before', 'after']) AS x)"""


def _flat_paths(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n = F.col("s_suppkey")
    method = F.element_at(F.array(*map(F.lit, ("CHROM", "LGI", "POS"))), (1 + n % 3).cast("int"))
    return rows.select(F.concat(F.lit("study/"), method, F.lit("/"), F.lpad(n.cast("string"), 3, "0"), F.when(n % 2 == 0, "_Before_").otherwise("_after_"), F.when(n % 5 == 0, "12").otherwise(F.lower(F.substring("n_name", 1, 5))), F.lit(".csv")).alias("path"))


def _deep_paths(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 3, "0").alias("s"))
    each = rows.withColumn("m", F.explode(F.array(*map(F.lit, ("CHROM", "LGI", "GREEN"))))).withColumn("r", F.explode(F.array(*map(F.lit, ("roi_3", "Left-Cheek", "chin")))))
    each = each.where((F.col("s_suppkey") + F.length("m") + F.length("r")) % 4 != 0)
    waves_ = each.select(F.concat("s", F.lit("/video/images-"), "s", F.lit("_FullHDwebcam_"), F.when(F.col("s_suppkey") % 7 == 0, "after").otherwise("before"), F.lit("/rPPG-pulse/"), "m", F.lit("/"), "r", F.lit("/bandpass_pulse.csv")).alias("path"))
    signals = rows.select("*", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("x")).select(F.concat("s", F.lit("/"), F.when(F.col("s_suppkey") % 2 == 0, "b").otherwise("a"), F.lit("_PPG_"), "x", F.lit(".csv")).alias("path"))
    return waves_.unionByName(signals)


@query(f"""SELECT path AS source, CASE WHEN regexp_matches(lower(split_part(path, '/', 3)), '^\\d+[_-]?[a-z]+[_-]?[a-z]+') THEN split_part(path, '/', 2) || '_' || regexp_extract(lower(split_part(path, '/', 3)), '^(\\d+)[_-]?([a-z]+)[_-]?([a-z]+)', 3) || '_' || regexp_extract(lower(split_part(path, '/', 3)), '^(\\d+)[_-]?([a-z]+)[_-]?([a-z]+)', 2)
 || '/' || regexp_extract(lower(split_part(path, '/', 3)), '^(\\d+)', 1) || '.csv' END AS target FROM ({_FLAT_PATHS}) WHERE path NOT LIKE '%12.csv' UNION ALL
 SELECT path, split_part(path, '/', 2) || '_' || right(p, 1) || '_' || left(p, length(p) - 1) || '/' || left(split_part(path, '/', 3), 3) || '.csv' FROM (SELECT path, lower(split_part(split_part(path, '/', 3), '_', 2)) AS p FROM ({_FLAT_PATHS})) WHERE path LIKE '%12.csv'""")
def layout_by_region(spark, d):
    return layout.by_method_and_region(_flat_paths(spark, d))


@query(f"""SELECT path AS source, split_part(path, '/', 5) || '/' || split_part(path, '/', 1) || '_' || CASE WHEN path LIKE '%_before/%' THEN 'before' ELSE 'after' END || '_' || CASE split_part(path, '/', 6) WHEN 'roi_3' THEN 'roi03' WHEN 'chin' THEN 'chin' ELSE 'leftchee' END || '.csv' AS target FROM ({_DEEP_PATHS}) WHERE path LIKE '%/rPPG-pulse/%' AND split_part(path, '/', 5) <> 'GREEN'
 UNION ALL SELECT min(path), 'PPG/' || split_part(path, '/', 1) || '_after.csv' FROM ({_DEEP_PATHS}) WHERE path NOT LIKE '%/rPPG-pulse/%' GROUP BY split_part(path, '/', 1)""")
def layout_by_method(spark, d):
    return layout.by_method(_deep_paths(spark, d))


_WANTED = "SELECT lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS subject, method, region, lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '/video/images-' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '_FullHDwebcam_before/rPPG-pulse/' || method || '/' || region || '/bandpass_pulse.csv' AS path FROM supplier, (SELECT unnest(['CHROM', 'POS']) AS method), (SELECT unnest(['chin', 'roi_3']) AS region)"


def _wanted(spark, d):
    subjects = table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 3, "0").alias("subject"))
    return layout.expected(subjects, ["CHROM", "POS"], ["chin", "roi_3"])


@query(f"SELECT * FROM ({_WANTED}) WHERE path NOT IN ({_DEEP_PATHS})")
def layout_missing(spark, d):
    return layout.missing(_deep_paths(spark, d), _wanted(spark, d))


@query(f"SELECT path AS source, method || '_' || region || '_before/' || subject || '.csv' AS target FROM ({_WANTED}) WHERE path IN ({_DEEP_PATHS})")
def layout_by_subject(spark, d):
    return layout.by_subject(_deep_paths(spark, d), _wanted(spark, d))


@query("SELECT sid, arg_max(path, row(o, path)) AS path FROM (SELECT o_custkey % 997 AS sid, 'x/' || o_clerk0 || '/' || lpad(CAST(o_custkey % 997 AS VARCHAR), 3, '0') || '_' || substr(o_orderpriority, 3, 3) || (['.csv', '.txt', '.CSV', '.dat'])[1 + o_orderkey % 4] AS path, ([1, 3, 2, 0])[1 + o_orderkey % 4] AS o FROM (SELECT *, CAST(o_orderkey % 13 AS VARCHAR) AS o_clerk0 FROM orders)) WHERE o > 0 GROUP BY sid")
def index_sid_last(spark, d):
    x = table(spark, d, "orders")
    suffix = F.element_at(F.array(*map(F.lit, (".csv", ".txt", ".CSV", ".dat"))), (1 + F.col("o_orderkey") % 4).cast("int"))
    path = F.concat(F.lit("x/"), (F.col("o_orderkey") % 13).cast("string"), F.lit("/"), F.lpad((F.col("o_custkey") % 997).cast("string"), 3, "0"), F.lit("_"), F.substring("o_orderpriority", 3, 3), suffix)
    return layout.index_by_subject(x.select(path.alias("path")))


# recordings' text as it lies in files




@query("""WITH e AS (SELECT 'f' || user_id AS file, user_id % 4 AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value AS v FROM events)
SELECT file, n - 1 AS "row", CASE WHEN kind < 3 THEN n / 8.0::DOUBLE END AS time_sec, CASE WHEN n % 11 = 0 THEN NULL ELSE round(v, 4) + 0.0 END AS value, n % 11 = 0 AS bad FROM e""")
def scan_mixed_text(spark, d):
    """Signals written as lines of four forms, each eleventh value a word, read back."""
    x = event_signals(spark, d).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("file"), (F.col("k") % 4).alias("kind"), "t", (F.round("v", 4) + 0.0).alias("v"))
    value = F.when(F.col("t") % 11 == 0, "none").otherwise(F.col("v").cast("string"))
    sec = (F.col("t") / 8).cast("string")
    line = F.when(F.col("kind") == 0, F.concat(sec, F.lit(","), value)).when(F.col("kind") == 1, F.concat(value, F.lit(";x;"), sec)).when(F.col("kind") == 2, F.concat(F.lit(" "), sec, F.lit("\t"), value)).otherwise(value)
    heads = x.where("t = 1").select("file", F.lit(0).cast("long").alias("place"), F.when(F.col("kind") == 0, "time_sec,Pulse").when(F.col("kind") == 1, "PPG;note;Timestamp").alias("value")).where("value is not null")
    lines = x.select("file", F.col("t").alias("place"), line.alias("value")).unionByName(heads)
    return recordings.parsed(lines)


# envelopes through extrema and spectra of intervals

_SIDES = f"""xr AS MATERIALIZED (SELECT ev.*, count(*) OVER (PARTITION BY k) AS n, min(v) OVER b AS lb, min(v) OVER f AS lf, max(v) OVER b AS hb, max(v) OVER f AS hf FROM ev WINDOW b AS (PARTITION BY k ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
 xs AS (SELECT k, t, v, true AS side FROM xr WHERE t > 1 AND t < n AND v > hb AND v > hf UNION ALL SELECT k, t, v, false FROM xr WHERE t > 1 AND t < n AND v < lb AND v < lf),
 kn AS MATERIALIZED (SELECT k, side, CAST(t AS DOUBLE) AS x, v, row_number() OVER (PARTITION BY k, side ORDER BY t) - 1 AS j FROM xs QUALIFY count(*) OVER (PARTITION BY k, side) > 1),
 sp0 AS MATERIALIZED (SELECT k, side, min(x) AS a, max(x) AS b FROM kn GROUP BY k, side), gr AS MATERIALIZED (SELECT ev.k, side, t AS i, CAST(t AS DOUBLE) AS x FROM ev JOIN sp0 USING (k) WHERE t BETWEEN a AND b)"""


def _envelope_sql() -> str:
    ends = "CASE WHEN t < a AND a + 4 > b THEN NULL WHEN t < a THEN (SELECT avg(v) FROM sq WHERE sq.k = o.k AND sq.side = o.side AND sq.i > o.a AND sq.i <= o.a + 4) WHEN t > b THEN (SELECT avg(v) FROM sq WHERE sq.k = o.k AND sq.side = o.side AND sq.i < o.b AND sq.i >= o.b - 4) ELSE s END"
    rows = f"(SELECT k, t, side, {ends} AS e FROM (SELECT ev.k, ev.t, sp0.side, a, b, sq.v AS s FROM ev JOIN sp0 USING (k) LEFT JOIN sq ON sq.k = ev.k AND sq.side = sp0.side AND sq.i = ev.t) o)"
    return f"WITH RECURSIVE {EV}, {_SIDES}, {spline_through('kn', 'gr', 'k, side')} SELECT ev.k, ev.t - 1 AS i, {R6('max(e) FILTER (WHERE side)')} AS upper, {R6('max(e) FILTER (WHERE NOT side)')} AS lower FROM ev LEFT JOIN {rows} r ON r.k = ev.k AND r.t = ev.t GROUP BY ev.k, ev.t"


ORACLE_SQL["sig_envelopes"] = _envelope_sql()

_INTERVALS = f"""xr AS MATERIALIZED (SELECT ev.*, min(v) OVER b AS lb, min(v) OVER f AS lf FROM ev WINDOW b AS (PARTITION BY k ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
 vl AS (SELECT k, t, (lead(t) OVER (PARTITION BY k ORDER BY t) - t) / 6.0::DOUBLE AS g FROM xr WHERE coalesce(v < lb AND v < lf, false)), ib AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) AS p, CASE WHEN g BETWEEN 0.33 AND 1.5 THEN g END AS g FROM vl),
 nr AS (SELECT *, count(g) OVER (PARTITION BY k) AS good, last_value(CASE WHEN g IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p0, last_value(g IGNORE NULLS) OVER a AS g0, first_value(CASE WHEN g IS NOT NULL THEN p END IGNORE NULLS) OVER z AS p1, first_value(g IGNORE NULLS) OVER z AS g1 FROM ib WINDOW a AS (PARTITION BY k ORDER BY p), z AS (PARTITION BY k ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 fi AS (SELECT k, p, coalesce(g, g0 + (g1 - g0) * (p - p0) / (p1 - p0), g0, g1) AS v FROM nr WHERE good > 1), kn AS MATERIALIZED (SELECT k, p - 1 AS j, sum(v) OVER (PARTITION BY k ORDER BY p) AS x, v FROM fi),
 gs AS (SELECT k, min(x) AS f, CAST(ceil((max(x) - min(x)) * 2 - 1e-9) AS BIGINT) AS m FROM kn GROUP BY k), gr AS MATERIALIZED (SELECT k, i, f + i * 0.5::DOUBLE AS x FROM gs, range(0, 10000) r(i) WHERE i < m)"""
ORACLE_SQL["sig_interval_spectrum"] = f"""WITH RECURSIVE {EV}, {_INTERVALS}, {spline_through('kn', 'gr')}, co AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM sq),
 ft AS (SELECT co.k, b.i, sum(v * cos(2 * pi() * ((b.i * co.i) % n) / n)) AS c, sum(v * sin(2 * pi() * ((b.i * co.i) % n) / n)) AS s FROM co JOIN range(0, 1000) b(i) ON b.i < ceil(n / 2) GROUP BY co.k, b.i) SELECT k, i, {R6('sqrt(c * c + s * s)')} AS v FROM ft"""


def _polynomials(n: int, degree: int) -> str:
    """CTEs that end in `po` (i, p0 to p{degree}): orthogonal polynomials on n places, each from the two before."""
    ctes = [f"o0 AS (SELECT i, i - {(n - 1) / 2}::DOUBLE AS x, 1.0::DOUBLE AS p0 FROM range({n}) g(i))", "o1 AS (SELECT *, x AS p1 FROM o0)"]
    for k in range(2, degree + 1):
        ctes.append(f"o{k} AS (SELECT *, x * p{k - 1} - p{k - 2} * (SELECT sum(p{k - 1} * p{k - 1}) / sum(p{k - 2} * p{k - 2}) FROM o{k - 1}) AS p{k} FROM o{k - 1})")
    return ", ".join([*ctes, f"po AS MATERIALIZED (SELECT i, {', '.join(f'p{k} / sqrt(sum(p{k} * p{k}) OVER ()) AS p{k}' for k in range(degree + 1))} FROM o{degree})"])


ORACLE_SQL["sig_second_differences"] = f"""WITH RECURSIVE {BT}, sr AS (SELECT k, beat, pos AS j, v FROM bt), {spline(100, 'sr', 'k, beat')}, df AS MATERIALIZED (SELECT * FROM (SELECT k, beat, i, (lead(v, 2) OVER w - 2 * lead(v) OVER w + v) * 10000 AS v FROM sp WINDOW w AS (PARTITION BY k, beat ORDER BY i)) WHERE v IS NOT NULL),
 {_polynomials(98, 5)}, co AS (SELECT k, beat, {', '.join(f'sum(v * p{k}) AS c{k}' for k in range(6))} FROM df JOIN po USING (i) GROUP BY k, beat) SELECT k, beat, i, round({' + '.join(f'c{k} * p{k}' for k in range(6))}, 3) + 0.0 AS v FROM co, po"""


# features of mean shapes

_SHAPES = f"""ch AS MATERIALIZED (SELECT k, beat FROM (SELECT *, {_NEAR} AS near FROM st) WHERE near), sj AS (SELECT bm.k, bm.beat, pos - {_MARGIN} AS j, v FROM bm JOIN ch ON bm.k = ch.k AND bm.beat = ch.beat WHERE pos >= {_MARGIN}), {spline(90, 'sj', 'k, beat', 'r')},
 e1 AS (SELECT k, i AS pos, avg(CASE WHEN h - l <= 1e-8 THEN 0 ELSE (v - l) / nullif(h - l, 0) * 2 END) AS v FROM (SELECT *, min(v) OVER (PARTITION BY k, beat) AS l, max(v) OVER (PARTITION BY k, beat) AS h FROM spr) GROUP BY k, i),
 e2 AS (SELECT k, pos, v - (first_value(v) OVER w + (last_value(v) OVER w - first_value(v) OVER w) * pos / 89) AS v FROM e1 WINDOW w AS (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 bt AS MATERIALIZED (SELECT k, 1 AS beat, pos, CASE WHEN max(v) OVER b - min(v) OVER b <= 1e-8 THEN 0 ELSE (v - min(v) OVER b) / (max(v) OVER b - min(v) OVER b) * 2 END AS v FROM e2 WINDOW b AS (PARTITION BY k))"""


def _usual_beats(spark, d):
    x = colour_traces(spark, d).select("k", "t", F.avg("g").over(series("k", "t").rowsBetween(-3, 3)).alias("v"))
    return x, beats.usual(beats.margin_statistics(beats.cut_with_margin(x, _REACH, _MARGIN), _MARGIN)).select("k", "beat")


@query(f"WITH RECURSIVE {_SOFT}, {_CUT}, {_FLAT}, {_STATS}, {_SHAPES} SELECT k, {', '.join(f'{c} AS cn_{c}' for c in _CN)} FROM ({ORACLE_SQL['beat_contour'].replace('WITH ' + BT + ',', 'WITH')})")
def study_representative_contours(spark, d):
    x, chosen = _usual_beats(spark, d)
    told = studies.representative_contours(x, chosen, _REACH, 90)
    return told.select("k", *(F.col(f"cn_{c}") if c in ("t1", "t2", "t_sub") or c.startswith("width") else r6(f"cn_{c}").alias(f"cn_{c}") for c in _CN))


@query()
def study_representative_features(spark, d):
    x, chosen = _usual_beats(spark, d)
    told = studies.representative_features(x, chosen, _REACH, _MARGIN, 90)
    return told.select("k", "beats", *(r6(c, 4).alias(c) for c in ("cn_t_div", "cn_width50", "dr_b_a", "dr_ageing", "dr_v_top")))
