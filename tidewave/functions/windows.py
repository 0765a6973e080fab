"""Column functions over ordered series: neighbours, extrema, gaps, scaling."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str] | str, order: str) -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def whole(keys: list[str] | str) -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys))


def difference(v: str, w: WindowSpec) -> Column:
    return F.lead(v).over(w) - F.col(v)


def gradient(v: str, w: WindowSpec) -> Column:
    """Central difference, one-sided at the ends; null for a series of one sample."""
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return F.coalesce((after - before) / 2, after - F.col(v), F.col(v) - before)


def is_extreme(v: str, w: WindowSpec, reach: int, low: bool = False) -> Column:
    """Strictly above (below) all samples within reach on both sides, of which there must be some."""
    best = F.min if low else F.max
    before, after = best(v).over(w.rowsBetween(-reach, -1)), best(v).over(w.rowsBetween(1, reach))
    found = (F.col(v) < before) & (F.col(v) < after) if low else (F.col(v) > before) & (F.col(v) > after)
    return F.coalesce(found, F.lit(False))


def filled(v: str, order: str, w: WindowSpec, empty: float | None = 0.0) -> Column:
    """Nulls on the line between their neighbours, the nearest value at the ends, `empty` if all are null."""
    here = F.when(F.col(v).isNotNull(), F.struct(F.col(order).alias("t"), F.col(v).alias("v")))
    back = F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    between = back["v"] + (ahead["v"] - back["v"]) * (F.col(order) - back["t"]) / F.nullif(ahead["t"] - back["t"], F.lit(0))
    return F.coalesce(F.col(v), between, back["v"], ahead["v"], F.lit(empty))


def zscore(v: str, w: WindowSpec, eps: float = 1e-8) -> Column:
    """By the population deviation; 0 for a flat series."""
    sd = F.stddev_pop(v).over(w)
    return F.when(sd < eps, F.lit(0.0)).otherwise((F.col(v) - F.avg(v).over(w)) / (sd + eps))


def minmax(v: str, w: WindowSpec, eps: float = 1e-8) -> Column:
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high - low < eps, F.lit(0.0)).otherwise((F.col(v) - low) / F.nullif(high - low, F.lit(0.0)))
