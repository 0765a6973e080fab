"""Errors, correlations and clinical grades of estimates against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators.filters import pair_distances

#: Fixed values of the grading rules: least shares within 5, 10 and 15 for the grades A to C; the bound of mean and deviation.
BHS = (("A", 0.60, 0.85, 0.95), ("B", 0.50, 0.75, 0.90), ("C", 0.40, 0.65, 0.85))
AAMI_MEAN, AAMI_SD = 5.0, 8.0
LIMITS = (5, 10, 15)


def errors(x: DataFrame, keys: list[str], true: str = "y", pred: str = "p", eps: float = 1e-12) -> DataFrame:
    e = F.col(pred) - F.col(true)
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.covar_pop(true, pred) / (F.stddev_pop(true) * F.stddev_pop(pred) + eps)).alias("r"))


def aami(x: DataFrame, keys: list[str], true: str = "y", pred: str = "p") -> DataFrame:
    """Mean, sample deviation (0 for one row) and mean absolute error; does it pass?"""
    e = F.col(pred) - F.col(true)
    found = x.groupBy(*keys).agg(F.avg(e).alias("me"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("sd"), F.avg(F.abs(e)).alias("mae"))
    return found.withColumn("passes", (F.abs("me") <= AAMI_MEAN) & (F.col("sd") <= AAMI_SD))


def bhs(x: DataFrame, keys: list[str], true: str = "y", pred: str = "p", strict: bool = False) -> DataFrame:
    """Shares of errors within each limit (strict: below it) and the grade."""
    e = F.abs(F.col(pred) - F.col(true))
    shares = x.groupBy(*keys).agg(*(F.avg(F.when((e < n) if strict else (e <= n), 1.0).otherwise(0.0)).alias(f"within{n}") for n in LIMITS))
    grade = F.lit(None).cast("string")
    for name, *least in BHS[::-1]:
        met = F.lit(True)
        for n, share in zip(LIMITS, least, strict=True):
            met = met & (F.col(f"within{n}") >= share)
        grade = F.when(met, F.lit(name)).otherwise(grade)
    return shares.withColumn("grade", F.coalesce(grade, F.lit("D")))


def mae_corr_loss(x: DataFrame, keys: list[str], weight: float = 0.5, true: str = "y", pred: str = "p", eps: float = 1e-8) -> DataFrame:
    r = F.covar_pop(true, pred) / (F.stddev_pop(true) * F.stddev_pop(pred) + eps)
    return x.groupBy(*keys).agg((weight * F.avg(F.abs(F.col(pred) - F.col(true))) + (1 - weight) * (1 - r)).alias("loss"))


def ensemble_mean(x: DataFrame, keys: list[str], fold: str = "fold", pred: str = "p") -> DataFrame:
    return x.groupBy(*keys).agg(F.avg(pred).alias("mean"), F.stddev_pop(pred).alias("spread"), F.count_distinct(fold).alias("folds"))


def window_losses(x: DataFrame, keys: list[str], weight: str, true: str = "y", pred: str = "p", eps: float = 1e-8) -> DataFrame:
    """Training losses of each window: mean absolute error plain and weighted, 1 - r^2 plain and weighted, and the plain ones' sum.

    Weighted moments are taken from the weighted means, which a first pass finds on the same exchange: large offsets cost no digits.
    """
    every = Window.partitionBy(*keys)
    total = F.greatest(F.sum(weight).over(every), F.lit(eps))
    rows = x.select(*keys, F.col(true).alias("t"), F.col(pred).alias("g"), (F.col(weight) / total).alias("w"), (F.sum(F.col(weight) * F.col(pred)).over(every) / total).alias("mg"), (F.sum(F.col(weight) * F.col(true)).over(every) / total).alias("mt"))
    w, g, t, e = F.col("w"), F.col("g") - F.col("mg"), F.col("t") - F.col("mt"), F.abs(F.col("g") - F.col("t"))
    raw = rows.groupBy(*keys).agg(
        F.avg(e).alias("mae"), F.sum(w * e).alias("weighted_mae"), F.covar_pop("g", "t").alias("c"), F.var_pop("g").alias("vg"), F.var_pop("t").alias("vt"),
        F.sum(w * g * t).alias("wc"), F.sum(w * g * g).alias("wg"), F.sum(w * t * t).alias("wt"),
    )
    c = F.col
    root = lambda v: F.sqrt(F.greatest(c(v), F.lit(eps)))
    loss = lambda cov, a, b: 1 - (c(cov) / (root(a) * root(b) + eps)) ** 2
    told = raw.select(*keys, "mae", "weighted_mae", loss("c", "vg", "vt").alias("corr"), loss("wc", "wg", "wt").alias("weighted_corr"))
    return told.withColumn("mae_and_corr", c("mae") + c("corr"))


def weight_penalties(x: DataFrame, keys: list[str], weight: str, order: str, goal: float = 0.6) -> DataFrame:
    """Squared distance of the mean weight from the goal, and the mean step between neighbouring weights, over all windows."""
    step = F.abs(F.lead(weight).over(Window.partitionBy(*keys).orderBy(order)) - F.col(weight))
    return x.select(weight, step.alias("_step")).agg(((F.avg(weight) - goal) ** 2).alias("cover"), F.avg("_step").alias("variation"))


def mean_over_files(x: DataFrame, keys: list[str], true: str = "y", pred: str = "p") -> DataFrame:
    """Both signals z-scored (sample deviation) in each file, their errors, and the mean over files: one row."""
    w = Window.partitionBy(*keys)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))
    per = errors(x.select(*keys, z(true).alias(true), z(pred).alias(pred)), keys, true, pred)
    return per.agg(F.count(F.lit(1)).alias("files"), *(F.avg(c).alias(c) for c in ("mae", "rmse", "r")))


def over_windows(x: DataFrame, keys: list[str], true: str = "y", pred: str = "p") -> DataFrame:
    """Mean and population deviation over windows of correlation and root mean square error: one row."""
    per = errors(x, keys, true, pred)
    return per.agg(F.count(F.lit(1)).alias("windows"), *(f(c).alias(f"{c}_{n}") for c in ("r", "rmse") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))


def both_scales(x: DataFrame, true: str = "y", pred: str = "p", window: int | None = None, eps: float = 1e-8) -> DataFrame:
    """Scores of standardised predictions (k, t, true, pred) of each series: r_std, rmse_std and dtw_std against the standardised true values, and r, rmse and dtw after the predictions are put in the true values' scale.

    Standardised by the population deviation. Warping distances are over the steps of their path; in the true scale both
    signals are standardised for it once more.
    """
    w = Window.partitionBy("k")
    mean, sd = F.avg("y").over(w), F.stddev_pop("y").over(w) + eps
    rows = x.select("k", "t", F.col(true).alias("y"), F.col(pred).alias("p"))
    rows = rows.select("k", "t", "y", "p", ((F.col("y") - mean) / sd).alias("z"), (F.col("p") * sd + mean).alias("q"))
    scaled = lambda c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + eps)
    first = errors(rows, ["k"], "z", "p").select("k", "n", F.col("r").alias("r_std"), F.col("rmse").alias("rmse_std"))
    second = errors(rows, ["k"], "y", "q").select("k", "r", "rmse")
    near = pair_distances(rows.select("k", "t", F.col("z").alias("a"), F.col("p").alias("b")), window, "path").withColumnRenamed("dtw", "dtw_std")
    far = pair_distances(rows.select("k", "t", scaled("y").alias("a"), scaled("q").alias("b")), window, "path")
    return first.join(second, "k").join(near, "k").join(far, "k")
