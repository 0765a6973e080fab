"""More registered queries: relations of a study, folds of equal size, losses, rates and spectra, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.functions.windows import whole
from tidewave.operators import metrics, relational, signal, splits
from tidewave.plans.catalogue import _EXTREME, _SUBJECT, ALL, BT, EV, PAIR, R6, R9, RGB, _pair, _subjects, _values, query, r6
from tidewave.sources.tables import colour_traces, cut_beats, event_signals, table

# relations


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount, l_shipdate FROM lineitem")
def prefix_projection(spark, d):
    return relational.with_prefix(table(spark, d, "lineitem"), ("l_tax", "l_dis", "l_shipd"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 5 AND 120 AND c_custkey NOT IN (7, 11, 40)")
def id_range_exclude(spark, d):
    return relational.in_range(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 5, 120, (7, 11, 40))


_GAPS = "SELECT l_orderkey, l_linenumber, nullif(l_tax, 0.0) AS y, nullif(l_discount, 0.05) AS p FROM lineitem"


@query(f"SELECT * FROM ({_GAPS}) WHERE y IS NOT NULL AND p IS NOT NULL")
def dropna_subset(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("y"), F.nullif("l_discount", F.lit(0.05)).alias("p"))
    return relational.complete(x, ["y", "p"])


@query("SELECT * FROM (VALUES ('lineitem', true), ('orders', false), ('part', false)) t(name, complete)")
def required_columns(spark, d):
    found = [(n, relational.has_columns(table(spark, d, n), ["l_tax", "l_discount"])) for n in ("lineitem", "orders", "part")]
    return spark.createDataFrame(found, "name string, complete boolean")


@query("SELECT n_name AS roi, method FROM nation, (SELECT unnest(['CHROM', 'LGI', 'POS']) AS method)")
def cross_list(spark, d):
    return relational.each_with(table(spark, d, "nation").select(F.col("n_name").alias("roi")), "method", ["CHROM", "LGI", "POS"])


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_features(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return relational.stacked([a, b])


_FOLD = "CAST(('0x' || substr(md5(CAST(\"row\" AS VARCHAR)), 1, 8)) AS BIGINT) % 5"


@query(f"SELECT subject FROM {_SUBJECT} WHERE {_FOLD} <> 0 INTERSECT SELECT subject FROM {_SUBJECT} WHERE {_FOLD} = 0")
def leak_check(spark, d):
    x = splits.row_folds(_subjects(spark, d), "row", 5)
    return relational.leaked(x.where("fold <> 0"), x.where("fold = 0"), "subject")


@query(f'SELECT subject, "row", row_number() OVER (PARTITION BY subject ORDER BY "row") - 1 AS place FROM {_SUBJECT}')
def group_members(spark, d):
    return relational.members(_subjects(spark, d), "subject", "row")


@query(f"WITH {RGB} SELECT k, t, 'r' AS channel, r AS v FROM rgb UNION ALL SELECT k, t, 'g', {R6('g')} FROM rgb UNION ALL SELECT k, t, 'b', {R6('b')} FROM rgb")
def unpivot_channels(spark, d):
    return relational.melted(colour_traces(spark, d), ["k", "t"], ["r", "g", "b"]).select("k", "t", "channel", r6("v").alias("v"))


@query(f"WITH {BT}, m AS (SELECT k, beat, max(v) > 0.2 AS a, avg(v) >= 0 AS b FROM bt GROUP BY k, beat) SELECT k, beat, a AND b AS good FROM m")
def mask_and(spark, d):
    per = cut_beats(spark, d).groupBy("k", "beat").agg((F.max("v") > 0.2).alias("a"), (F.avg("v") >= 0).alias("b"))
    return per.select("k", "beat", (F.col("a") & F.col("b")).alias("good"))


# folds


@query(f'SELECT "row", ntile(5) OVER (ORDER BY md5(CAST("row" AS VARCHAR))) - 1 AS fold FROM {_SUBJECT}')
def fold_indices(spark, d):
    return splits.equal_folds(_subjects(spark, d), "row", 5).select("row", "fold")


_PLACE = f'(SELECT "row", row_number() OVER (ORDER BY md5(CAST("row" AS VARCHAR))) - 1 AS place, count(*) OVER () AS n FROM {_SUBJECT})'


@query(f"""SELECT "row", CASE WHEN place < floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM {_PLACE}""")
def split_train_val(spark, d):
    return splits.train_val(_subjects(spark, d), "row", 0.1).select("row", "part")


@query(f"""SELECT "row", CASE WHEN place < floor(n * 0.6::DOUBLE) THEN 'train' WHEN place < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM {_PLACE}""")
def split_rows_602020(spark, d):
    return splits.random_three_way(_subjects(spark, d), "row").select("row", "part")


# losses

_W = PAIR.replace("AS p FROM", "AS p, 0.1 + l_tax AS w, l_linenumber AS n FROM")


def _weighted(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("y"), (F.col("l_quantity") + 100 * (F.col("l_discount") - 0.05)).alias("p"), (0.1 + F.col("l_tax")).alias("w"))


@query(f"""WITH {_W}, m AS (SELECT *, sum(w * p) {ALL} / sum(w) {ALL} AS mp, sum(w * y) {ALL} / sum(w) {ALL} AS my FROM pair),
 s AS (SELECT k, avg(abs(p - y)) AS mae, sum(w * abs(p - y)) / sum(w) AS weighted_mae, 1 - pow(covar_pop(p, y) / (sqrt(greatest(var_pop(p), 1e-8)) * sqrt(greatest(var_pop(y), 1e-8)) + 1e-8), 2) AS corr,
 1 - pow(sum(w * (p - mp) * (y - my)) / sum(w) / (sqrt(greatest(sum(w * (p - mp) * (p - mp)) / sum(w), 1e-8)) * sqrt(greatest(sum(w * (y - my) * (y - my)) / sum(w), 1e-8)) + 1e-8), 2) AS weighted_corr FROM m GROUP BY k)
SELECT k, {R6('mae')} AS mae, {R6('weighted_mae')} AS weighted_mae, {R6('corr')} AS corr, {R6('weighted_corr')} AS weighted_corr, {R6('mae + corr')} AS mae_and_corr FROM s""")
def window_losses(spark, d):
    found = metrics.window_losses(_weighted(spark, d), ["k"], "w")
    return found.select("k", *(r6(c).alias(c) for c in ("mae", "weighted_mae", "corr", "weighted_corr", "mae_and_corr")))


@query(f"WITH {RGB}, w AS (SELECT k, t, b / 12 AS w FROM rgb), s AS (SELECT w, abs(lead(w) OVER (PARTITION BY k ORDER BY t) - w) AS step FROM w) SELECT {R9('pow(avg(w) - 0.6, 2)')} AS cover, {R9('avg(step)')} AS variation FROM s")
def weight_penalties(spark, d):
    x = colour_traces(spark, d).select("k", "t", (F.col("b") / 12).alias("w"))
    return metrics.weight_penalties(x, ["k"], "w", "t").select(r6("cover", 9).alias("cover"), r6("variation", 9).alias("variation"))


@query(f"""WITH {PAIR}, z AS (SELECT k, (y - avg(y) {ALL}) / nullif(stddev_samp(y) {ALL}, 0) AS y, (p - avg(p) {ALL}) / nullif(stddev_samp(p) {ALL}, 0) AS p FROM pair),
 e AS (SELECT k, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p) + 1e-12) AS r FROM z GROUP BY k)
SELECT count(*) AS files, {R6('avg(mae)')} AS mae, {R6('avg(rmse)')} AS rmse, {R6('avg(r)')} AS r FROM e""")
def eval_mean_over_files(spark, d):
    return metrics.mean_over_files(_pair(spark, d), ["k"]).select("files", *(r6(c).alias(c) for c in ("mae", "rmse", "r")))


@query(f"""WITH {PAIR}, e AS (SELECT k, sqrt(avg((p - y) * (p - y))) AS rmse, covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p) + 1e-12) AS r FROM pair GROUP BY k)
SELECT count(*) AS windows, {R6('avg(r)')} AS r_mean, {R6('stddev_pop(r)')} AS r_sd, {R6('avg(rmse)')} AS rmse_mean, {R6('stddev_pop(rmse)')} AS rmse_sd FROM e""")
def eval_over_windows(spark, d):
    return metrics.over_windows(_pair(spark, d), ["k"]).select("windows", *(r6(c).alias(c) for c in ("r_mean", "r_sd", "rmse_mean", "rmse_sd")))


# signals

_RUNS = f"""q AS (SELECT k, t, floor(v / 10) AS v FROM ev), c AS (SELECT *, coalesce(CAST(lag(v) OVER (PARTITION BY k ORDER BY t) <> v AS BIGINT), 0) AS new FROM q),
 u AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t) AS run FROM c), f AS (SELECT k, run, first(v) AS v, min(t) AS a, max(t) AS b FROM u GROUP BY k, run),
 n AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY run) AS p, lead(v) OVER (PARTITION BY k ORDER BY run) AS q FROM f)"""


@query(f"WITH {EV}, {_RUNS} SELECT k, (a + b) // 2 AS t, v FROM n WHERE v > p AND v > q")
def peaks_with_plateaus(spark, d):
    return signal.peaks(event_signals(spark, d).select("k", "t", F.floor(F.col("v") / 10).cast("double").alias("v")))


@query(f"""WITH {EV}, e AS (SELECT k, t, v, {_EXTREME.format('>', 'max')} AS peak, {_EXTREME.format('<', 'min')} AS valley FROM ev),
 n AS (SELECT k, t, v, CASE WHEN peak THEN 'peak' ELSE 'valley' END AS kind, row_number() OVER (PARTITION BY k, peak ORDER BY t) AS nth FROM e WHERE peak OR valley) SELECT * FROM n WHERE nth > 2""")
def peaks_without_first_two(spark, d):
    return signal.extrema_without_first(event_signals(spark, d), 2)


@query(f"""WITH {EV}, s AS (SELECT k, (t - 1) / 6.0::DOUBLE AS x, v FROM ev), n AS (SELECT k, max(x) AS e FROM s GROUP BY k), g AS (SELECT k, i, i / 4.0::DOUBLE AS x FROM n, range(100000) r(i) WHERE i / 4.0::DOUBLE < e AND i <= e * 4 + 1),
 b AS (SELECT g.k, g.i, g.x, s.x AS x0, s.v AS v0 FROM g ASOF JOIN s ON g.k = s.k AND g.x >= s.x), c AS (SELECT b.*, s.x AS x1, s.v AS v1 FROM b ASOF LEFT JOIN s ON b.k = s.k AND b.x <= s.x)
SELECT k, i, {R6('coalesce(v0 + (v1 - v0) * (x - x0) / nullif(x1 - x0, 0), v0)')} AS v FROM c""")
def sig_at_rate(spark, d):
    x = event_signals(spark, d).select("k", ((F.col("t") - 1) / 6.0).alias("sec"), "v")
    return signal.at_rate(x, "sec", 4.0).select("k", "i", r6("v").alias("v"))


_DFT = """n AS (SELECT k, count(*) AS n FROM ev GROUP BY k), s AS (SELECT ev.k, bin, max(n) AS n, sum(v * cos(2 * pi() * ((bin * (t - 1)) % n) / n)) AS c, sum(v * sin(2 * pi() * ((bin * (t - 1)) % n) / n)) AS s FROM ev JOIN n ON ev.k = n.k JOIN range(0, 500) r(bin) ON bin < ceil(n / 2) GROUP BY ev.k, bin),
 m AS (SELECT k, bin, n, sqrt(c * c + s * s) AS size FROM s)"""


@query(f"WITH {EV}, {_DFT}, f AS (SELECT *, bin * 6.0::DOUBLE / n AS f FROM m) SELECT k, {R6('CASE WHEN max(n) >= 64 THEN 60 * max_by(f, row(round(size, 6), -bin)) FILTER (WHERE f BETWEEN 0.7 AND 4) END')} AS bpm FROM f GROUP BY k")
def sig_hr_band(spark, d):
    return signal.heart_rate_by_spectrum(event_signals(spark, d), 6.0).select("k", r6("bpm").alias("bpm"))


_FLAT = "ev AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS v FROM ev0)"


@query(f"""WITH {EV.replace('ev AS', 'ev0 AS')}, {_FLAT}, {_DFT}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(size, 6) DESC, bin) AS r FROM m),
 p AS (SELECT k, min(bin) AS peak, floor(0.3 * max(n) / 6.0) AS reach FROM o WHERE r <= 2 GROUP BY k),
 q AS (SELECT m.k, max(peak) AS bin, max(reach) AS reach, max(bin) AS last, sum(size) AS total, sum(size * (CAST(abs(bin - peak) <= reach AS INT) + CAST(abs(bin - 2 * peak) <= reach AS INT) + CAST(abs(bin - 3 * peak) <= reach AS INT))) AS sig FROM m JOIN p ON m.k = p.k GROUP BY m.k)
SELECT k, bin, {R6('CASE WHEN bin >= reach AND 3 * bin + reach <= last AND total > sig THEN 10 * log10(sig / (total - sig)) END')} AS snr FROM q""")
def sig_snr(spark, d):
    x = event_signals(spark, d)
    flat = x.select("k", "t", (F.col("v") - F.avg("v").over(whole("k"))).alias("v"))
    return signal.signal_to_noise(flat, 6.0).select("k", "bin", r6("snr").alias("snr"))


_HOLES = "hole AS (SELECT k, t, CASE WHEN t > 3 AND t % 7 <> 0 AND t < max(t) OVER (PARTITION BY k) - 2 THEN v END AS v FROM ev)"


@query(f"""WITH {EV}, {_HOLES}, g AS (SELECT *, min(CASE WHEN v IS NOT NULL THEN t END) {ALL} AS a, max(CASE WHEN v IS NOT NULL THEN t END) {ALL} AS b FROM hole),
 h AS (SELECT *, avg(CASE WHEN t > a AND t <= a + 4 THEN v END) {ALL} AS head, avg(CASE WHEN t < b AND t >= b - 4 THEN v END) {ALL} AS tail,
 last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t) AS t0, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t) AS v0,
 first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1,
 first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM g)
SELECT k, t, {R6('CASE WHEN t < a THEN head WHEN t > b THEN tail ELSE coalesce(v, v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0)) END')} AS v FROM h""")
def sig_edges_filled(spark, d):
    x = event_signals(spark, d)
    hole = F.when((F.col("t") > 3) & (F.col("t") % 7 != 0) & (F.col("t") < F.max("t").over(whole("k")) - 2), F.col("v"))
    return _values(signal.edges_filled(x.select("k", "t", hole.alias("v"))))


@query(f"WITH {EV}, s AS (SELECT k, t, regr_slope(v, t) {ALL} AS b, regr_intercept(v, t) {ALL} AS a FROM ev) SELECT k, t, {R6('a + b * t')} AS v FROM s")
def sig_straight_fit(spark, d):
    return _values(signal.straight_fit(event_signals(spark, d)))


@query(f"WITH {EV} SELECT k, t, {R6('v')} AS v FROM ev")
def sig_normalised_none(spark, d):
    return _values(signal.normalised(event_signals(spark, d), "none"))
