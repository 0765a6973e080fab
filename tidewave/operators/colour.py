"""Pulse waves from colour traces: rows (k, t, r, g, b) to (k, t, v), one window pass or two, no UDF unless said."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.windows import filled, series, whole
from tidewave.operators.filters import apply_chain, bandpass

EPS = 1e-6
#: Fixed values of the skin model: absorbance directions of melanin and haemoglobin in red, green, blue.
MELANIN = (0.4143, 0.3570, 0.8372)
HEMOGLOBIN = (0.2988, 0.6838, 0.6657)
K, ORDER = "k", "t"
#: Recordings whose values are broadcast to their rows; more are joined by a shuffle.
RECORDINGS = 100_000


def hemo_weights(eps: float = 1e-8) -> tuple[float, float, float]:
    """The haemoglobin part as weights of the three densities: shading removed along (1, 1, 1), then least squares."""
    m, h, one = np.asarray(MELANIN), np.asarray(HEMOGLOBIN), np.ones(3)
    normal = np.cross(m, h)
    flat = np.eye(3) - np.outer(one, normal) / (normal @ one + eps)
    return tuple(float(x) for x in (np.linalg.pinv(np.stack([m, h], 1)) @ flat)[1])


def fill_gaps(rgb: DataFrame) -> DataFrame:
    w = series(K, ORDER)
    return rgb.select(K, ORDER, *(filled(c, ORDER, w).alias(c) for c in "rgb"))


def _keys(recording: str | None) -> list[str]:
    return [recording, K] if recording else [K]


def with_recordings(rgb: DataFrame, told: DataFrame, recording: str) -> DataFrame:
    """rgb with the columns of `told`, a row a recording, which is computed here: up to RECORDINGS rows are sent to all tasks, so that a recording's series stay spread."""
    found = told.limit(RECORDINGS + 1).toArrow()
    few = found.num_rows <= RECORDINGS
    told = (F.broadcast(rgb.sparkSession.createDataFrame(found, told.schema)) if few else told).withColumnRenamed(recording, "_rec")
    return rgb.join(told, F.col(recording).eqNullSafe(F.col("_rec"))).drop("_rec")


def normalised(rgb: DataFrame, recording: str | None = None) -> DataFrame:
    keys = _keys(recording)
    w = whole(keys)
    return rgb.select(*keys, ORDER, *((F.col(c) / (F.avg(c).over(w) + EPS)).alias(c) for c in "rgb"))


def to_shortest(rgb: DataFrame, recording: str | None = None) -> DataFrame:
    """Every series cut to the length of the shortest: of its recording, or without one of all."""
    if recording:
        ends = rgb.groupBy(*_keys(recording)).agg(F.max(ORDER).alias("_n")).groupBy(recording).agg(F.min("_n").alias("_n"))
        return with_recordings(rgb, ends, recording).where(F.col(ORDER) <= F.col("_n")).drop("_n")
    least = rgb.groupBy(K).agg(F.max(ORDER).alias("n")).agg(F.min("n").alias("n"))
    return rgb.join(F.broadcast(least), F.col(ORDER) <= F.col("n")).drop("n")  # one row


def _with_range(rgb: DataFrame, recording: str | None) -> DataFrame:
    """rgb with `scale`, the largest possible value (255 or 1), told by the largest one of the recording, or without one of all."""
    top = F.greatest("r", "g", "b")
    if recording:
        found = with_recordings(rgb, rgb.groupBy(recording).agg(F.max(top).alias("top")), recording)
    else:
        found = rgb.join(F.broadcast(rgb.agg(F.max(top).alias("top"))))  # one row
    return found.withColumn("scale", F.when(F.col("top") > 1.5, 255.0).otherwise(1.0)).drop("top")


def _densities(eps: float) -> list[Column]:
    return [-F.log(F.least(F.greatest(F.col(c) / F.col("scale"), F.lit(eps)), F.lit(1.0))) for c in "rgb"]


def green(rgb: DataFrame) -> DataFrame:
    return rgb.select(K, ORDER, (-F.col("g")).alias("v"))


def chrom(rgb: DataFrame) -> DataFrame:
    w = whole(K)
    xy = rgb.select(K, ORDER, (3 * F.col("r") - 2 * F.col("g")).alias("x"), (1.5 * F.col("r") + F.col("g") - 1.5 * F.col("b")).alias("y"))
    alpha = F.stddev_pop("x").over(w) / (F.stddev_pop("y").over(w) + EPS)
    return xy.select(K, ORDER, (-(F.col("x") - alpha * F.col("y"))).alias("v"))


def pos(rgb: DataFrame, fps: float = 30.0) -> DataFrame:
    """Each window of 1.6 s gives a projection; a sample is the sum over the windows that hold it: two window passes.

    Sums over a window are differences of running sums, so the work doesn't grow with its length. Colours are taken from
    their series' mean first; variances that the running sums' rounding would give alone count as 0.
    """
    n = max(3, round(1.6 * fps))
    w = series(K, ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    products = ("rr", "gg", "bb", "gb", "rg", "rb")
    flat = rgb.select(K, ORDER, "r", "g", "b", *(F.avg(x).over(whole(K)).alias(f"o{x}") for x in "rgb"))
    flat = flat.select("*", *((c(x) - c(f"o{x}")).alias(f"d{x}") for x in "rgb"))
    sums = flat.select("*", *(F.sum(f"d{x}").over(upto).alias(f"s{x}") for x in "rgb"), *(F.sum(c(f"d{x}") * c(f"d{y}")).over(upto).alias(f"s{x}{y}") for x, y in products), *(F.sum(c(f"d{x}") * c(f"d{x}")).over(whole(K)).alias(f"all{x}") for x in "rgb"))
    ahead = {x: (F.lead(f"s{x}", n - 1).over(w) - F.coalesce(F.lag(f"s{x}").over(w), F.lit(0.0))) / n for x in (*"rgb", *products)}
    own = sums.select(K, ORDER, "r", "g", "b", "or", "og", "ob", "allr", "allg", "allb", *(v.alias(f"m{x}") for x, v in ahead.items()))
    own = own.select(K, ORDER, "r", "g", "b", *(c(f"all{x}") for x in "rgb"), *((c(f"m{x}") + c(f"o{x}")).alias(f"m{x}") for x in "rgb"), *((c(f"m{x}{y}") - c(f"m{x}") * c(f"m{y}")).alias(f"c{x}{y}") for x, y in products))
    own = own.select("*", *((1 / (c(f"m{x}") + EPS)).alias(f"k{x}") for x in "rgb"))
    kr, kg, kb = c("kr"), c("kg"), c("kb")
    least = 1e-13 * (kg * kg * c("allg") + kb * kb * c("allb"))
    first = kg * kg * c("cgg") + kb * kb * c("cbb") - 2 * kg * kb * c("cgb")
    second = 4 * kr * kr * c("crr") + kg * kg * c("cgg") + kb * kb * c("cbb") - 4 * kr * kg * c("crg") - 4 * kr * kb * c("crb") + 2 * kg * kb * c("cgb")
    root = lambda v, least: F.when(v <= least, F.lit(0.0)).otherwise(F.sqrt(v))
    alpha = root(first, least) / (root(second, least + 4e-13 * kr * kr * c("allr")) + EPS)
    own = own.select(K, ORDER, "r", "g", "b", "mr", "mg", "mb", "kr", "kg", "kb", alpha.alias("alpha"))
    own = own.select(K, ORDER, "r", "g", "b", "mr", "mg", "mb", (-2 * c("alpha") * kr).alias("a1"), (kg * (1 + c("alpha"))).alias("a2"), (kb * (c("alpha") - 1)).alias("a3"))
    own = own.select(K, ORDER, "r", "g", "b", "a1", "a2", "a3", (c("a1") * c("mr") + c("a2") * c("mg") + c("a3") * c("mb")).alias("a4"))
    names = ("a1", "a2", "a3", "a4")
    run = own.select(K, ORDER, "r", "g", "b", *(F.coalesce(F.sum(x).over(upto), F.lit(0.0)).alias(x) for x in names))
    total = {x: c(x) - F.coalesce(F.lag(x, n).over(w), F.lit(0.0)) for x in names}
    return run.select(K, ORDER, (c("r") * total["a1"] + c("g") * total["a2"] + c("b") * total["a3"] - total["a4"]).alias("v"))


def omit(rgb: DataFrame) -> DataFrame:
    """Green without the direction of the first frame's colour."""
    w = series(K, ORDER)
    first = [F.first(c).over(w) for c in "rgb"]
    held = rgb.select(K, ORDER, "r", "g", "b", *(x.alias(f"q{c}") for x, c in zip(first, "rgb", strict=True)))
    dot = F.col("qr") * F.col("r") + F.col("qg") * F.col("g") + F.col("qb") * F.col("b")
    norm = F.col("qr") * F.col("qr") + F.col("qg") * F.col("qg") + F.col("qb") * F.col("qb")
    return held.select(K, ORDER, (F.col("g") - F.col("qg") * dot / F.nullif(norm, F.lit(0.0))).alias("v"))


def pbv(rgb: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """Weights that give the blood-volume signature, by Cramer's rule on six sums."""
    w = whole(K)
    x = normalised(rgb)
    pairs = ("rr", "gg", "bb", "rg", "rb", "gb")
    held = x.select(K, ORDER, "r", "g", "b", *(F.sum(F.col(a) * F.col(b)).over(w).alias(a + b) for a, b in pairs), *(F.stddev_pop(c).over(w).alias(f"s{c}") for c in "rgb"), *(F.var_pop(c).over(w).alias(f"v{c}") for c in "rgb"))
    c = F.col
    scale = F.sqrt(c("vr") + c("vg") + c("vb")) + EPS
    p, q, s = (c(f"s{x}") / scale for x in "rgb")
    rr, gg, bb, rg, rb, gb = c("rr") + ridge, c("gg") + ridge, c("bb") + ridge, c("rg"), c("rb"), c("gb")
    det = rr * (gg * bb - gb * gb) - rg * (rg * bb - gb * rb) + rb * (rg * gb - gg * rb)
    wr = p * (gg * bb - gb * gb) - rg * (q * bb - gb * s) + rb * (q * gb - gg * s)
    wg = rr * (q * bb - gb * s) - p * (rg * bb - gb * rb) + rb * (rg * s - q * rb)
    wb = rr * (gg * s - q * gb) - rg * (rg * s - q * rb) + p * (rg * gb - gg * rb)
    held = held.select(K, ORDER, "r", "g", "b", p.alias("p"), q.alias("q"), s.alias("s"), *(F.try_divide(x, det).alias(n) for n, x in (("wr", wr), ("wg", wg), ("wb", wb))))
    return held.select(K, ORDER, ((c("r") * c("wr") + c("g") * c("wg") + c("b") * c("wb")) / (c("p") * c("wr") + c("q") * c("wg") + c("s") * c("wb") + EPS)).alias("v"))


def hemo(rgb: DataFrame, normalise: bool = True, eps: float = 1e-8, recording: str | None = None) -> DataFrame:
    """Haemoglobin absorbance. The range (0 to 1 or 0 to 255) is told by the largest value of the recording, or without one of all series."""
    x = _with_range(normalised(rgb, recording) if normalise else rgb, recording)
    value = sum((w * d for w, d in zip(hemo_weights(), _densities(eps), strict=True)), F.lit(0.0))
    return x.select(*_keys(recording), ORDER, F.exp(-F.greatest(value, F.lit(0.0))).alias("v"))


def _gram(rgb: DataFrame, key: str = K) -> DataFrame:
    """Sums of products and of each colour, one row a series."""
    return rgb.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{c}") for c in "rgb"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("rr", "gg", "bb", "rg", "rb", "gb")))


def _directions(rgb: DataFrame, centred: bool, component: int, key: str = K) -> DataFrame:
    """An eigenvector of each series' 3 x 3 matrix, a pandas UDF over one row of sums a series; its green part is positive."""

    def solve(batches):
        for x in batches:
            g = np.zeros((len(x), 3, 3))
            for a, b in ("rr", "gg", "bb", "rg", "rb", "gb"):
                g[:, "rgb".index(a), "rgb".index(b)] = g[:, "rgb".index(b), "rgb".index(a)] = x[a + b]
            if centred:
                s = x[["sr", "sg", "sb"]].to_numpy(float)
                g = (g - s[:, :, None] * s[:, None, :] / x["n"].to_numpy()[:, None, None]) / np.maximum(x["n"].to_numpy() - 1, 1)[:, None, None]
            v = np.linalg.eigh(g)[1][:, :, ::-1][:, :, component]
            v = v * np.where(v[:, 1:2] < 0, -1, 1)
            yield pd.DataFrame({key: x[key], "er": v[:, 0], "eg": v[:, 1], "eb": v[:, 2]})

    return _gram(rgb, key).mapInPandas(solve, f"{key} {dict(rgb.dtypes)[key]}, er double, eg double, eb double")


def lgi(rgb: DataFrame) -> DataFrame:
    """Green without the strongest common direction of the uncentred trace."""
    x = rgb.join(_directions(rgb, False, 0), K)
    dot = F.col("er") * F.col("r") + F.col("eg") * F.col("g") + F.col("eb") * F.col("b")
    return x.select(K, ORDER, (F.col("g") - F.col("eg") * dot).alias("v"))


def pca(rgb: DataFrame, component: int = 1) -> DataFrame:
    """A principal component (from 0) of the centred trace."""
    w = whole(K)
    x = rgb.select(K, ORDER, *((F.col(c) - F.avg(c).over(w)).alias(c) for c in "rgb")).join(_directions(rgb, True, component), K)
    return x.select(K, ORDER, (F.col("er") * F.col("r") + F.col("eg") * F.col("g") + F.col("eb") * F.col("b")).alias("v"))


def pca_both(rgb: DataFrame) -> DataFrame:
    """The first two principal components, weighted by their share of the variance of both."""
    one, two = (pca(rgb, i).withColumnRenamed("v", f"v{i}") for i in (0, 1))
    w = whole(K)
    var = [F.var_samp(f"v{i}").over(w) for i in (0, 1)]
    mixed = F.try_divide(var[0] * F.col("v0") + var[1] * F.col("v1"), var[0] + var[1])
    return one.join(two, [K, ORDER]).select(K, ORDER, mixed.alias("v"))


def fast_ica(x: np.ndarray, rounds: int = 400, tolerance: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Three independent components of a trace (3, T): whitening, then fixed-point steps on all of them (log cosh), from a seeded start; zeros if it can't be whitened."""
    x = x - x.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(x @ x.T / x.shape[1])
    if x.shape[1] < 4 or values[0] <= 1e-12 * max(values[-1], 1e-300):
        return np.zeros(x.shape)
    z = (vectors / np.sqrt(values)).T @ x

    def apart(w: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(w @ w.T)
        return (u / np.sqrt(np.maximum(s, 1e-300))) @ u.T @ w

    w = apart(np.random.RandomState(seed).normal(size=(3, 3)))
    for _ in range(rounds):
        g = np.tanh(w @ z)
        new = apart(g @ z.T / z.shape[1] - (1 - g * g).mean(1)[:, None] * w)
        moved = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if moved < tolerance:
            break
    return w @ z


def ica(rgb: DataFrame, component: int | None = 1) -> DataFrame:
    """An independent component of the trace (from 0), or with None all three, weighted by their variances.

    Components have no order or sign of their own: they are sorted by how much they take of green, of which their part is positive.
    """
    keyed = rgb.select(K, F.struct(ORDER, "r", "g", "b").alias("_s")).groupBy(K).agg(F.array_sort(F.collect_list("_s")).alias("_s"))

    def run(batches):
        for batch in batches:
            rows = batch.column("_s")
            out = []
            for i in range(batch.num_rows):
                values = rows[i].values
                x = np.stack([values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "rgb"])
                s = fast_ica(x)
                share = s @ (x[1] - x[1].mean())
                s = (s * np.where(share < 0, -1, 1)[:, None])[np.argsort(-np.abs(share), kind="stable")]
                var = s.var(1, keepdims=True) + 1e-6
                out.append((s[component] if component is not None else (s * var).sum(0) / var.sum()).tolist())
            t = pa.array([rows[i].values.field(ORDER).to_pylist() for i in range(batch.num_rows)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(K), t, pa.array(out, pa.list_(pa.float64()))], [K, "t", "v"])

    done = keyed.mapInArrow(run, f"{K} long, t array<long>, v array<double>").select(K, F.explode(F.arrays_zip("t", "v")).alias("_s"))
    return done.select(K, F.col("_s.t").alias(ORDER), F.col("_s.v").alias("v"))


def skin_flat(rgb: DataFrame, eps: float = 1e-8, recording: str | None = None) -> DataFrame:
    """Densities of each colour without shading (r, g, b), and the haemoglobin part (hemo). The range is told by the largest value of the recording, or without one of all series."""
    m, h, one = np.asarray(MELANIN), np.asarray(HEMOGLOBIN), np.ones(3)
    normal = np.cross(m, h)
    shade = [float(x) for x in normal / (normal @ one + eps)]
    keys = _keys(recording)
    x = _with_range(rgb, recording).select(*keys, ORDER, *(d.alias(c) for d, c in zip(_densities(eps), "rgb", strict=True)))
    light = sum((w * F.col(c) for w, c in zip(shade, "rgb", strict=True)), F.lit(0.0))
    value = sum((w * F.col(c) for w, c in zip(hemo_weights(eps), "rgb", strict=True)), F.lit(0.0))
    return x.select(*keys, ORDER, *((F.col(c) - light).alias(c) for c in "rgb"), value.alias("hemo"))


def lgi_global(rgb: DataFrame, eps: float = 1e-8, recording: str | None = None) -> DataFrame:
    """Every series' z-scored green without the strongest direction of the mean trace over the recording's series, or without one over all."""
    keys = _keys(recording)
    w = whole(keys)
    z = rgb.select(*keys, ORDER, *(((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + eps)).alias(c) for c in "rgb"))
    dot = F.col("er") * F.col("r") + F.col("eg") * F.col("g") + F.col("eb") * F.col("b")
    if recording:
        mean = z.groupBy(recording, ORDER).agg(*(F.avg(c).alias(c) for c in "rgb"))
        x = z.join(F.broadcast(_directions(mean, False, 0, recording)), recording)  # a row a recording
    else:
        mean = z.groupBy(ORDER).agg(*(F.avg(c).alias(c) for c in "rgb")).withColumn(K, F.lit(0).cast("long"))
        x = z.join(F.broadcast(_directions(mean, False, 0).select("er", "eg", "eb")))  # one row
    return x.select(*keys, ORDER, (F.col("g") - F.col("eg") * dot).alias("v"))


def robust(rgb: DataFrame, rate: float, low: float = 0.7, high: float = 3.0, recording: str | None = None) -> DataFrame:
    """Shading removed, the common direction of the recording's series (without one: of all) removed, and the band of pulses (third order)."""
    flat = lgi_global(skin_flat(rgb, recording=recording), recording=recording)
    return apply_chain(flat, [bandpass(low, high, rate, 3)], tuple(_keys(recording)))


def box_means(pixels: DataFrame, boxes: list[tuple[str, int, int, int, int]], colours: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Mean colours of pixels (frame, x, y and colours) in each of a few boxes (name, x0, x1, y0, y1; ends exclusive), by frame.

    Every box is a conditional mean of one aggregation, so no pixel is copied; boxes become rows after it. Without a pixel
    in a box its means are null and its row is still there.
    """
    x, y = F.col("x"), F.col("y")
    inside = {roi: (x >= x0) & (x < x1) & (y >= y0) & (y < y1) for roi, x0, x1, y0, y1 in boxes}
    means = [F.struct(F.lit(roi).alias("roi"), *(F.avg(F.when(fits, F.col(c))).alias(c) for c in colours)) for roi, fits in inside.items()]
    rows = pixels.groupBy("frame").agg(F.array(*means).alias("_boxes"))
    return rows.select("frame", F.explode("_boxes").alias("_b")).select("frame", "_b.*")


def polygon_spans(corners: DataFrame) -> DataFrame:
    """Scan lines of polygons: (frame, roi, y, x0, x1), the whole pixels x0 to x1 of row y that lie inside or on the border.

    corners: (frame, roi, i, x, y), whole numbers, i the order along the border, the last one joined to the first. Each edge
    gives its crossing with every row it passes (the lower end counts, the upper one doesn't); crossings of a row, sorted,
    open and close spans in turn. Rows that only a corner or a level edge touches get spans of their own.
    """
    keys = ("frame", "roi")
    w = Window.partitionBy(*keys).orderBy("i")
    ends = corners.select(*keys, "x", "y", "i", F.coalesce(F.lead("x").over(w), F.first("x").over(w)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(w)).alias("y2"))
    steep = ends.where("y <> y2").select(*keys, F.when(F.col("y") < F.col("y2"), F.struct("x", "y", F.col("x2").alias("u"), F.col("y2").alias("v"))).otherwise(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("x").alias("u"), F.col("y").alias("v"))).alias("e"))
    rows = steep.select(*keys, "e", F.explode(F.sequence(F.col("e.y"), F.col("e.v") - 1)).alias("y"))
    at = F.col("e.x") + (F.col("y") - F.col("e.y")) * (F.col("e.u") - F.col("e.x")) / (F.col("e.v") - F.col("e.y"))
    sides = rows.select(*keys, "y", at.alias("at"))
    order = Window.partitionBy(*keys, "y").orderBy("at")
    paired = sides.select(*keys, "y", "at", F.row_number().over(order).alias("n"), F.lead("at").over(order).alias("to")).where("n % 2 = 1")
    spans = paired.select(*keys, "y", F.ceil(F.round("at", 9)).alias("x0"), F.floor(F.round("to", 9)).alias("x1"))
    level = ends.where("y = y2").select(*keys, "y", F.least("x", "x2").alias("x0"), F.greatest("x", "x2").alias("x1"))
    points = ends.select(*keys, "y", F.col("x").alias("x0"), F.col("x").alias("x1"))
    return spans.unionByName(level).unionByName(points).where("x0 <= x1")


def polygon_means(pixels: DataFrame, corners: DataFrame, colours: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Mean colours of the pixels (frame, x, y and colours) in each polygon of their frame, by frame and roi.

    Spans of a row that meet count once. They are joined by frame and row, and the span's ends are a condition on the rows
    that meet; a row of a frame has few spans.
    """
    w = Window.partitionBy("frame", "roi", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = polygon_spans(corners).select("frame", "roi", "y", F.greatest(F.col("x0"), F.coalesce(reach + 1, F.col("x0"))).alias("x0"), "x1").where("x0 <= x1")
    meet = pixels.join(cut, ["frame", "y"]).where(F.col("x").between(F.col("x0"), F.col("x1")))
    return meet.groupBy("frame", "roi").agg(F.count("*").alias("pixels"), *(F.avg(c).alias(c) for c in colours))


def mask_means(pixels: DataFrame, mask: DataFrame, colours: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Mean colours of the pixels in each region's mask (roi, x, y), by frame."""
    return pixels.join(mask, ["x", "y"]).groupBy("frame", "roi").agg(*(F.avg(c).alias(c) for c in colours))


METHODS = {"GREEN": green, "CHROM": chrom, "POS": pos, "LGI": lgi, "OMIT": omit, "PBV": pbv, "PCA": pca, "HEMO": hemo, "ICA": ica}


def extract_pulse(rgb: DataFrame, method: str) -> DataFrame:
    """Fill gaps, normalise (not for GREEN) and project."""
    if method.upper() not in METHODS:
        raise ValueError(f"no method {method}; there are {', '.join(METHODS)}")
    rgb = fill_gaps(rgb)
    method = method.upper()
    return METHODS[method](rgb if method in ("GREEN", "HEMO", "PBV") else normalised(rgb))


def group_mean(rgb: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean colour of each group's members at each frame, nulls left out. groups: (k, group), a small bridge."""
    return rgb.join(groups, K).groupBy("group", ORDER).agg(*(F.avg(c).alias(c) for c in "rgb"))


def drift(centres: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Distance of each frame's centre from the first one known."""
    w = series(K, ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dx: Column = F.col(x) - F.first(x, True).over(w)
    dy: Column = F.col(y) - F.first(y, True).over(w)
    return centres.select(K, ORDER, F.sqrt(dx * dx + dy * dy).alias("v"))
