"""Training of networks, stored models, support vector regression, search of settings, warping distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import networks, training


@pytest.mark.parametrize("attend", [False, True])
def test_gradients_equal_finite_differences(attend):
    rng = np.random.RandomState(3)
    shapes = networks.recurrent_shapes(2, (4, 3), attend)
    w = {n: rng.normal(size=s) * 0.5 for n, s in shapes.items()}
    x, y = rng.normal(size=(3, 6, 2)), rng.normal(size=(3, 6))
    loss, slopes = training.gradients(x, y, w, 2, attend, 0.4)
    net = networks.recurrent_net(2, attend)
    values, found = training.flat(w), training.flat(slopes)
    at = lambda v: training.loss_and_slope(net(x, training.shaped(v, shapes)), y, 0.4)[0]
    assert np.isclose(loss, at(values))
    for i in rng.choice(len(values), 60, replace=False):
        step = np.zeros(len(values))
        step[i] = 1e-6
        assert np.isclose(found[i], (at(values + step) - at(values - step)) / 2e-6, rtol=1e-4, atol=1e-6)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.RandomState(1)
    rows = []
    for k in range(4):
        for win in range(12):
            a = np.cumsum(rng.normal(size=17))
            rows += [(k, win, i, float(a[i]), float(rng.normal()), float(0.8 * a[i + 1] - 0.2)) for i in range(16)]
    return spark.createDataFrame(rows, "k long, win long, pos long, a double, b double, y double")


def test_training_lowers_the_loss_and_its_weights_are_kept(spark, windows, tmp_path):
    folds = {}
    for fold in (0, 1):
        part = windows.where(F.col("k") % 2 != fold)
        folds[fold], history = training.trained(part, ["a", "b"], "y", sizes=(6,), attend=False, epochs=8, rate=0.03, steps=2, seed=fold)
        assert [h["epoch"] for h in history] == list(range(1, len(history) + 1)) and history[-1]["train_loss"] < 0.8 * history[0]["train_loss"]
    again, _ = training.trained(windows.where("k % 2 <> 0"), ["a", "b"], "y", sizes=(6,), attend=False, epochs=8, rate=0.03, steps=2, seed=0)
    assert all(np.allclose(again[n], folds[0][n]) for n in again)
    path = str(tmp_path / "weights")
    training.save_weights(spark, folds, path)
    held = training.load_weights(spark, path)
    net = networks.recurrent_net(1)
    told = training.fold_predictions(windows, ["a", "b"], held, net)
    for fold in (0, 1):
        one = {(r.k, r.win, r.pos): r.prediction for r in networks.applied(windows, ["a", "b"], net, folds[fold]).collect()}
        got = {(r.k, r.win, r.pos): r.prediction for r in told.where(F.col("fold") == fold).collect()}
        assert got.keys() == one.keys() and all(np.isclose(got[x], one[x]) for x in got)
    scaled = training.fold_predictions(windows.withColumn("m", F.lit(70.0)).withColumn("s", F.lit(10.0)), ["a", "b"], held, net, mean="m", sd="s")
    both = told.join(scaled.withColumnRenamed("prediction", "p"), ["k", "win", "pos", "fold"])
    assert both.count() == 2 * 4 * 12 * 16 and both.where("abs(prediction * 10 + 70 - p) > 1e-6").count() == 0


def test_the_rate_falls_and_training_stops(windows):
    _, history = training.trained(windows, ["a"], "y", sizes=(2,), attend=False, epochs=12, rate=50.0, patience=0, stop=4, steps=1)
    assert len(history) < 12 and history[-1]["rate"] < 50.0


def exact_machine(x, y, C, epsilon, gamma, rounds=400):
    """The dual by coordinate steps; a constant in the kernel stands for the intercept."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2)) + 1.0
    beta = np.zeros(len(y))
    out = k @ beta
    for _ in range(rounds):
        for i in range(len(y)):
            g = y[i] - out[i] + k[i, i] * beta[i]
            new = np.clip(np.sign(g) * max(abs(g) - epsilon, 0) / k[i, i], -C, C)
            out += k[:, i] * (new - beta[i])
            beta[i] = new
    return out


def test_support_vectors_equal_the_exact_dual(spark):
    from tidewave.operators import regression

    rng = np.random.RandomState(5)
    x = rng.uniform(-2, 2, (200, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(size=200) * 0.05
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, y double")
    scaled = (x - x.mean(0)) / x.std(0)
    want = exact_machine(scaled, y, 1.0, 0.1, 0.5)
    machine = regression.fit_support_vectors(df, ["a", "b"], "y", C=1.0, epsilon=0.1, size=512)
    got = np.asarray([r.prediction for r in machine.transform(df).orderBy("i").collect()])
    assert np.abs(got - want).mean() < 0.05 and np.abs(got - y).mean() < 0.12  # random cosines stand for the kernel
    again = regression.SupportVectors.of(["a", "b"], machine.as_weights())
    assert np.allclose([r.prediction for r in again.transform(df).orderBy("i").collect()], got)


def test_folds_are_stored_and_kept(spark, tmp_path):
    from tidewave.operators import regression

    rows = [(i, i % 3, float(i % 7) if i % 5 else None, float((i * 3) % 11), float(2 * (i % 7) + (i * 3) % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, fold int, a double, b double, y double")
    for kind, settings in (("linear", {}), ("svr", {"size": 64, "C": 10.0})):
        store = str(tmp_path / kind)
        plain = {r.i: r.prediction for r in regression.out_of_fold(df, ["a", "b"], "y", kind, **settings).collect()}
        kept = regression.out_of_fold(df, ["a", "b"], "y", kind, store=store, **settings)
        assert len(plain) == 120 and {r.i: round(r.prediction, 6) for r in kept.collect()} == {i: round(p, 6) for i, p in plain.items()}
        assert kept._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
        again = regression.out_of_fold(df.withColumn("y", F.lit(0.0)), ["a", "b"], "y", kind, store=store, **settings)  # nothing is fitted anew
        assert {r.i: round(r.prediction, 6) for r in again.collect()} == {i: round(p, 6) for i, p in plain.items()}


def test_search_finds_a_planted_optimum_and_goes_on(spark, tmp_path):
    from tidewave.operators import regression

    space = {"c": ("log", 1e-2, 1e3), "depth": ("int", 1, 30), "how": ("choice", ["a", "b", "c"]), "e": ("float", 0.0, 1.0)}
    tried = []

    def objective(s):
        tried.append(s)
        return (np.log10(s["c"]) - 1) ** 2 + ((s["depth"] - 12) / 10) ** 2 + (s["how"] != "b") + (s["e"] - 0.3) ** 2

    store = str(tmp_path / "trials")
    regression.searched(spark, objective, space, trials=20, store=store)
    assert len(tried) == 20
    settings, loss = regression.searched(spark, objective, space, trials=80, store=store)
    assert len(tried) == 80 and settings["how"] == "b" and loss < 0.15  # a grid of four values each has 256 points
    tried.clear()
    assert regression.searched(spark, objective, space, trials=80, store=store) == (settings, loss) and not tried


def test_warping_of_many_pairs_equals_one_by_one():
    from tidewave.operators import filters

    rng = np.random.RandomState(2)
    n = np.array([1, 5, 17, 30, 30])
    a, b = (np.where(np.arange(30) < n[:, None], np.round(rng.normal(size=(5, 30)), 1), 0.0) for _ in range(2))
    for window in (None, 0, 3, 10):
        for how in (None, "len", "path"):
            got = filters.dtw_many(a, b, n, window, how)
            want = [filters.dtw(a[i, : n[i]], b[i, : n[i]], window, how) for i in range(5)]
            assert np.allclose(got, want), (window, how)


def test_quality_head_and_masked_attention_equal_loops():
    rng = np.random.RandomState(6)
    w = networks.seeded(networks.quality_shapes(2, 3, 5), 1)
    x = rng.normal(size=(2, 9, 2))
    got = networks.quality_head(x, w)
    for i in range(2):
        wide = np.pad(x[i], ((2, 2), (0, 0)))
        hidden = np.array([[max(0.0, (w["quality.conv1"][o] * wide[t : t + 5].T).sum() + w["quality.bias1"][o]) for o in range(3)] for t in range(9)])
        wide = np.pad(hidden, ((2, 2), (0, 0)))
        want = [1 / (1 + np.exp(-((w["quality.conv2"][0] * wide[t : t + 5].T).sum() + w["quality.bias2"][0]))) for t in range(9)]
        assert np.allclose(got[i], want)
    a = networks.seeded(networks.recurrent_shapes(2, (2,), True), 2)
    mask = np.array([[1, 1, 0, 0, 1, 1, 1, 1, 1]] * 2)
    there = mask[0] == 1
    assert np.allclose(networks.attention(x, a, "attention", mask)[:, there], networks.attention(x[:, there], a, "attention"))
    both = networks.recurrent_with_quality(1)(x, {**networks.seeded(networks.recurrent_shapes(2, (2,)), 3), **w})
    assert both.shape == (2, 9)


def test_settings_of_a_model_are_searched(spark):
    from tidewave.operators import regression

    rows = [(i, i % 2, float(i % 10), float(np.sin(i % 10))) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, fold int, a double, y double")
    settings, error = regression.tuned_by_search(df, ["a"], "y", "svr", {"C": ("log", 1e-3, 1e2), "epsilon": ("log", 1e-2, 1.0)}, trials=4, size=16, rounds=2)
    assert 1e-3 <= settings["C"] <= 1e2 and error == regression.error_out_of_fold(df, ["a"], "y", "svr")({**settings, "size": 16, "rounds": 2})
    for kind, space in regression.SPACES.items():
        one = regression.proposed(space, [], 1)
        assert set(one) == set(space) and kind in ("rf", "gbt", "svr")
