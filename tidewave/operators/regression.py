"""Blood pressure from features: exact median imputation, tree ensembles of pyspark.ml, support vector regression, predictions out of fold, and search of settings."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators.training import Weights

KINDS = {"rf": RandomForestRegressor, "gbt": GBTRegressor, "linear": LinearRegression}


def medians(x: DataFrame, features: list[str]) -> dict[str, float]:
    """The exact median of each feature; 0 where all are null."""
    row = x.agg(*(F.percentile(c, 0.5).alias(c) for c in features)).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in features}


def model(kind: str, features: list[str], target: str, **settings) -> Pipeline:
    """Features to a vector, scaled for the linear kind, and the regressor."""
    steps = [VectorAssembler(inputCols=features, outputCol="_raw")]
    if kind == "linear":
        steps.append(StandardScaler(withMean=True, inputCol="_raw", outputCol="_x"))
    fixed = {} if kind == "linear" else {"seed": 42}
    return Pipeline(stages=[*steps, KINDS[kind](featuresCol="_x" if kind == "linear" else "_raw", labelCol=target, predictionCol="prediction", **fixed, **settings)])


@dataclass
class SupportVectors:
    """Support vector regression with a radial kernel as a linear machine on random cosines: exp(-gamma |x - y|^2) is their mean product.

    fit() needs no pass over pairs: each step sums slopes and curvatures of the rows outside the tolerance in the tasks, and
    the driver solves a system of `size` unknowns. The corner of the loss at the tolerance is rounded over a width that
    falls from step to step.
    """

    features: list[str]
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Cosines of the scaled rows, and a one for the intercept."""
        z = np.cos((x - self.centre) / self.scale @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([z, np.ones(len(x))])

    def transform(self, x: DataFrame) -> DataFrame:
        """x and prediction."""
        rows = x.select(F.struct(*x.columns).alias("_row"), F.array(*[F.col(c).cast("double") for c in self.features]).alias("_x"))
        shared = x.sparkSession.sparkContext.broadcast(self)  # a model

        def run(batches):
            for batch in batches:
                own = shared.value
                flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(own.features))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(own.lifted(flat) @ own.weights)], ["_row", "prediction"])

        kind = rows.schema["_row"].dataType.simpleString()
        return rows.mapInArrow(run, f"_row {kind}, prediction double").select("_row.*", "prediction")

    def as_weights(self) -> Weights:
        """For training.save_weights."""
        return {c: getattr(self, c) for c in ("centre", "scale", "directions", "phases", "weights")}

    @classmethod
    def of(cls, features: list[str], weights: Weights) -> SupportVectors:
        return cls(features, *(weights[c] for c in ("centre", "scale", "directions", "phases", "weights")))


def fit_support_vectors(train: DataFrame, features: list[str], target: str, C: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, size: int = 256, seed: int = 42, rounds: int = 8) -> SupportVectors:
    """Least |w|^2 / 2 + C * sum of what |prediction - target| exceeds epsilon by; features scaled to deviation 1, gamma 1 / their number if not told."""
    stats = train.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)), F.avg(target).alias("y"), F.stddev_pop(target).alias("sy")).first()
    n = len(features)
    centre, scale = (np.asarray([stats[f"{k}{i}"] or 0.0 for i in range(n)], float) for k in "ms")
    rng = np.random.RandomState(seed)
    directions = rng.normal(size=(n, size)) * np.sqrt(2 * (gamma if gamma else 1 / n))
    machine = SupportVectors(features, centre, np.where(scale > 0, scale, 1.0), directions, rng.uniform(0, 2 * np.pi, size), np.append(np.zeros(size), stats["y"] or 0.0))
    rows = train.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y")).persist()
    keep = np.append(np.ones(size), 0.0)  # the intercept isn't held small

    def over(f, length: int) -> np.ndarray:
        def run(batches):
            total = np.zeros(length)
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                total += f(machine.lifted(x), batch.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], ["place", "value"])

        told = rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()  # at most size squared rows
        return told.sort_values("place")["value"].to_numpy()

    def lost(away: np.ndarray, width: float) -> np.ndarray:
        return np.where(away <= 0, 0.0, np.where(away < width, away * away / (2 * width), away - width / 2))

    try:
        w, wide, side = machine.weights, max(float(stats["sy"] or 0.0), 1e-6), np.triu_indices(size + 1)
        steps = 0.5 ** np.arange(8)
        for width in (wide, wide / 8, wide / 64, wide / 512):
            for _ in range(rounds):

                def moments(z, y, w=w, width=width):
                    r = z @ w - y
                    away = np.abs(r) - epsilon
                    slope = np.sign(r) * np.clip(away / width, 0, 1)
                    bent = z[(away > 0) & (away < width)]
                    return np.concatenate([z.T @ slope, (bent.T @ bent)[side] / width, [lost(away, width).sum()]])

                found = over(moments, size + 1 + len(side[0]) + 1)
                slope = keep * w + C * found[: size + 1]
                curve = np.zeros((size + 1, size + 1))
                curve[side] = C * found[size + 1 : -1]
                curve += np.triu(curve, 1).T + np.diag(keep + 1e-8 + (1 - keep) * 1e-6)
                way = np.linalg.solve(curve, slope)
                tried = over(lambda z, y, w=w, way=way, width=width: lost(np.abs(z @ (w[:, None] - way[:, None] * steps) - y[:, None]) - epsilon, width).sum(0), len(steps))
                costs = C * tried + np.array([((w - way * s)[:-1] ** 2).sum() / 2 for s in steps])
                now = C * found[-1] + (w[:-1] ** 2).sum() / 2
                best = int(np.argmin(costs))
                if costs[best] >= now * (1 - 1e-6):
                    break
                w = w - way * steps[best]
        machine.weights = w
        return machine
    finally:
        rows.unpersist()


def fitted(kind: str, train: DataFrame, features: list[str], target: str, **settings):
    """A model of any kind, on rows without gaps."""
    return fit_support_vectors(train, features, target, **settings) if kind == "svr" else model(kind, features, target, **settings).fit(train)


def out_of_fold(x: DataFrame, features: list[str], target: str, kind: str = "rf", fold: str = "fold", store: str | None = None, together: int = 4, **settings) -> DataFrame:
    """Every row with the prediction of a model that was fitted on the other folds, whose medians fill its gaps.

    Some folds are fitted at a time. With a store (a shared folder) each fold's predictions are written below it as it ends
    and read back, so the plan stays one scan however many folds there are; folds that are there already are kept.
    """
    folds = sorted(r[0] for r in x.select(fold).distinct().collect())  # as many as folds
    spark = x.sparkSession
    x = x.persist()

    def one(i):
        train, test = x.where(F.col(fold) != i), x.where(F.col(fold) == i)
        fill = medians(train, features)
        found = fitted(kind, train.where(F.col(target).isNotNull()).fillna(fill), features, target, **settings)
        told = found.transform(test.fillna(fill)).select(*x.columns, "prediction")
        if store is None:
            return told
        told.write.mode("overwrite").parquet(f"{store}/predictions/part={i}")
        if isinstance(found, SupportVectors):
            from tidewave.operators.training import save_weights

            save_weights(spark, {int(i): found.as_weights()}, f"{store}/models/part={i}")
        else:
            found.write().overwrite().save(f"{store}/models/part={i}")
        return None

    def there(i) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/models/part={i}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    try:
        with ThreadPoolExecutor(together) as pool:
            parts = list(pool.map(one, [i for i in folds if store is None or not there(i)]))
    finally:
        x.unpersist()
    if store is None:
        return reduce(DataFrame.unionByName, parts)
    return spark.read.parquet(f"{store}/predictions").drop("part")


def tuned(x: DataFrame, features: list[str], target: str, kind: str, grid: dict[str, list], fold: str = "fold") -> tuple[dict, float]:
    """The settings of a grid with the least mean absolute error out of fold, and that error; the first of equals."""
    best: tuple[dict, float] | None = None
    for values in product(*grid.values()):
        settings = dict(zip(grid, values, strict=True))
        error = out_of_fold(x, features, target, kind, fold, **settings).agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0]
        if best is None or error < best[1]:
            best = settings, error
    return best


# search by model

#: A setting's range: ("float", low, high), ("log", low, high), ("int", low, high) or ("choice", values).
Space = dict[str, tuple]


def _unit(kind: tuple, value) -> float:
    """A setting's value on 0 to 1."""
    if kind[0] == "choice":
        return (kind[1].index(value) + 0.5) / len(kind[1])
    low, high = (np.log(kind[1]), np.log(kind[2])) if kind[0] == "log" else kind[1:]
    return float(((np.log(value) if kind[0] == "log" else value) - low) / max(high - low, 1e-12))


def _value(kind: tuple, u: float):
    u = min(max(u, 0.0), 1.0)
    if kind[0] == "choice":
        return kind[1][min(int(u * len(kind[1])), len(kind[1]) - 1)]
    low, high = (np.log(kind[1]), np.log(kind[2])) if kind[0] == "log" else kind[1:]
    x = low + u * (high - low)
    return int(round(x)) if kind[0] == "int" else float(np.exp(x) if kind[0] == "log" else x)


def proposed(space: Space, history: list[tuple[dict, float]], seed: int, startup: int = 10, candidates: int = 24, share: float = 0.25) -> dict:
    """Settings worth a trial: at first by chance; then, of some drawn near the best share of the trials, those that are likelier there than near the others (tree-structured Parzen estimator, each setting by itself)."""
    rng = np.random.RandomState(seed)
    if len(history) < startup:
        return {name: _value(kind, rng.uniform()) for name, kind in space.items()}
    ordered = [s for s, _ in sorted(history, key=lambda h: h[1])]
    cut = max(1, int(np.ceil(share * len(ordered))))
    out = {}
    for name, kind in space.items():
        good, rest = (np.asarray([_unit(kind, s[name]) for s in part]) for part in (ordered[:cut], ordered[cut:]))

        def density(u: np.ndarray, points: np.ndarray) -> np.ndarray:
            width = max(1.0 / (1 + len(points)), 0.02) if kind[0] != "choice" else 0.5 / len(kind[1])
            bells = np.exp(-0.5 * ((u[:, None] - points) / width) ** 2) / width
            return (bells.sum(1) + 1.0) / (len(points) + 1)  # and a flat part, so that nothing is ruled out

        drawn = np.where(rng.uniform(size=candidates) < 1 / (len(good) + 1), rng.uniform(size=candidates), np.clip(rng.choice(good, candidates) + rng.normal(size=candidates) * max(1 / (1 + len(good)), 0.02), 0, 1))
        out[name] = _value(kind, float(drawn[np.argmax(density(drawn, good) / density(drawn, rest))]))
    return out


def searched(spark: SparkSession, objective: Callable[[dict], float], space: Space, trials: int = 40, together: int = 4, seed: int = 42, store: str | None = None, startup: int = 10) -> tuple[dict, float]:
    """The settings of least objective, and it. Some trials run at a time, each with its own Spark jobs.

    With a store, finished trials are rows (trial, settings, loss) of a table there, and a run that begins anew goes on after them.
    """
    history: list[tuple[dict, float]] = []
    if store is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            history = [(json.loads(r["settings"]), r["loss"]) for r in spark.read.schema("trial int, settings string, loss double").json(store).orderBy("trial").collect()]  # a row a trial
    with ThreadPoolExecutor(together) as pool:
        while len(history) < trials:
            batch = [proposed(space, history, seed + len(history) + i, startup) for i in range(min(together, trials - len(history)))]
            losses = list(pool.map(objective, batch))
            if store is not None:
                rows = [(len(history) + i, json.dumps(s), float(loss)) for i, (s, loss) in enumerate(zip(batch, losses, strict=True))]
                spark.createDataFrame(rows, "trial int, settings string, loss double").coalesce(1).write.mode("append").json(store)
            history += list(zip(batch, map(float, losses), strict=True))
    return min(history, key=lambda h: h[1])


def error_out_of_fold(x: DataFrame, features: list[str], target: str, kind: str, fold: str = "fold") -> Callable[[dict], float]:
    """The mean absolute error out of fold as an objective of settings."""
    return lambda settings: float(out_of_fold(x, features, target, kind, fold, **settings).agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0])


#: The ranges that the settings of each kind of model are searched in.
SPACES: dict[str, Space] = {
    "rf": {"numTrees": ("int", 100, 600), "maxDepth": ("int", 3, 30), "minInstancesPerNode": ("int", 1, 8)},
    "gbt": {"maxIter": ("int", 100, 800), "stepSize": ("log", 1e-3, 0.3), "maxDepth": ("int", 3, 8)},
    "svr": {"C": ("log", 1e-2, 1e3), "epsilon": ("log", 1e-3, 1.0)},
}


def tuned_by_search(x: DataFrame, features: list[str], target: str, kind: str, space: Space | None = None, trials: int = 40, fold: str = "fold", seed: int = 42, store: str | None = None, together: int = 2, **fixed) -> tuple[dict, float]:
    """The settings of least mean absolute error out of fold, searched by model in the kind's space (SPACES) or the one given; fixed settings hold in all trials."""
    error = error_out_of_fold(x, features, target, kind, fold)
    return searched(x.sparkSession, lambda s: error({**fixed, **s}), space or SPACES[kind], trials, together, seed, store)
