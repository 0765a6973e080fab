"""Splines, filters over many series, decompositions and wide peaks against closed forms and brute force."""

import numpy as np

from tidewave.operators import beats, colour, filters, networks, waves


def test_splines_give_cubics_back():
    f = lambda t: 2 - 3 * t + 4 * t**2 - 5 * t**3
    x, at = np.array([0, 0.3, 0.7, 1.5, 2.0]), np.linspace(0, 2, 31)
    assert np.allclose(waves.spline(x, np.stack([f(x), x**2]), at), [f(at), at**2])
    assert np.allclose(waves.spline(x[:3], x[:3] ** 2, at[:10]), at[:10] ** 2) and np.allclose(waves.spline(x[:2], 3 * x[:2], at[:4]), 3 * at[:4])
    rng = np.random.RandomState(0)
    y = rng.randn(40)
    t = np.arange(40.0)
    s = waves.slopes(t, y)  # second derivatives agree at inner knots, third ones at the outer inner knots
    left = 6 * (y[:-1] - y[1:]) + 2 * s[:-1] + 4 * s[1:]
    right = 6 * (y[1:] - y[:-1]) - 4 * s[:-1] - 2 * s[1:]
    assert np.allclose(left[:-1], right[1:])
    third = 12 * (y[:-1] - y[1:]) + 6 * (s[:-1] + s[1:])
    assert np.isclose(third[0], third[1]) and np.isclose(third[-1], third[-2])
    padded = np.zeros((3, 40))
    padded[0], padded[1, :5], padded[2, :1] = y, y[:5], 7
    assert np.allclose(waves.to_length(padded, np.array([40, 5, 1]), 40)[[0, 2]], [y, np.full(40, 7.0)])


def test_polyphase_keeps_slow_waves():
    v = np.sin(2 * np.pi * 1.2 * np.arange(1000) / 100)
    got = waves.polyphase(3, 10)(v)
    assert len(got) == 300 and np.abs(got - np.sin(2 * np.pi * 1.2 * np.arange(300) / 30))[20:-20].max() < 0.03
    taps, up = waves.kaiser_taps(3, 10), np.zeros(3000)
    up[::3] = v
    assert np.allclose(np.convolve(up, taps)[len(taps) // 2 :: 10][:300], got)


def test_steps_over_many_series_equal_one_by_one():
    rng = np.random.RandomState(1)
    n = np.array([80, 3, 41, 200, 16, 1, 120, 9])
    v = np.zeros((len(n), 200))
    for i, k in enumerate(n):
        v[i, :k] = np.cumsum(rng.randn(k))
    for step in (filters.detrend(30.0), filters.bandpass(0.75, 3.0, 30.0), filters.bandpass(0.7, 3.0, 30.0, 3), filters.lowpass(5.0, 30.0), filters.savitzky_golay(30.0), filters.by_envelope()):
        got = step.rows(v.copy(), n)
        for i, k in enumerate(n):
            assert np.allclose(got[i, :k], step(v[i, :k]), equal_nan=True)
    x = np.sin(np.arange(600) / 3) + np.sin(np.arange(600) * 2.5)
    assert np.abs(filters.lowpass(3.0, 30.0)(x)[60:-60] - np.sin(np.arange(600) / 3)[60:-60]).max() < 0.05


def test_independent_components_are_found():
    t = np.arange(900)
    sources = np.stack([np.sign(np.sin(t * 0.07)), np.sin(t * 0.13), np.random.RandomState(0).laplace(size=900)])
    got = colour.fast_ica(np.array([[1, 0.4, 0.3], [0.2, 1, 0.5], [0.3, 0.1, 1.0]]) @ sources)
    assert (np.abs(np.corrcoef(np.vstack([got, sources]))[:3, 3:]).max(1) > 0.98).all()
    assert (colour.fast_ica(np.ones((3, 50))) == 0).all()


def test_wide_peaks_and_derivative_waves():
    v = np.zeros(60)
    v[10:21] = 5 - np.abs(np.arange(-5, 6))
    v[30] = 9  # high, but not wide
    v[40:52] = np.minimum(np.arange(12), np.arange(11, -1, -1))  # a plateau of two
    assert beats.wide_peaks(v).tolist() == [15, 45]
    t = np.linspace(0, 1, 200)
    y = np.exp(-((t - 0.25) ** 2) / 0.008) + 0.45 * np.exp(-((t - 0.55) ** 2) / 0.012) + 0.02 * np.sin(8 * np.pi * t)
    told = dict(zip(beats.WAVES, beats.derivative_waves(y, 200.0), strict=True))
    two = np.diff(y, 2)
    assert told["a"] == two[int(told["a_at"])] and np.isclose(told["b_a"], told["b"] / told["a"]) and told["v_top"] == np.diff(y).max()
    assert beats.derivative_waves(np.linspace(0, 1, 50), 50.0) is None


def test_path_length_of_a_warping():
    a = np.array([0.0, 1, 2, 3])
    assert filters.dtw(a, a, None, "path") == 0 and np.isclose(filters.dtw(a, a + 1, 0, "path"), 1) and np.isclose(filters.dtw(a, a + 1, 0, "len"), 1)


def test_networks_equal_plain_loops():
    rng = np.random.RandomState(2)
    w = networks.seeded(networks.recurrent_shapes(2, (3,), True), 1)
    x = rng.randn(2, 5, 2)
    got = networks.recurrent(x, w, "layer0")
    sig = lambda v: 1 / (1 + np.exp(-v))
    for b in range(2):
        h = c = np.zeros(3)
        for t in range(5):
            i, f, g, o = np.split(w["layer0.weight_ih"] @ x[b, t] + w["layer0.weight_hh"] @ h + w["layer0.bias"], 4)
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            assert np.allclose(got[b, t], h)
    assert networks.recurrent_net(1, True)(x, w).shape == (2, 5)
    y, kernel = rng.randn(2, 3, 9), rng.randn(4, 3, 5)
    padded = np.pad(y, ((0, 0), (0, 0), (2, 2)))
    plain = [[[sum(kernel[o, c, j] * padded[b, c, t + j] for c in range(3) for j in range(5)) for t in range(9)] for o in range(4)] for b in range(2)]
    assert np.allclose(networks.convolved(y, kernel), plain)
    assert np.allclose(networks.stretched(np.array([0.0, 1, 2]), 6), [0, 0.25, 0.75, 1.25, 1.75, 2])
    weights = networks.seeded(networks.down_up_shapes(3, 4))
    z = rng.randn(3, 18, 1)
    assert networks.down_up_net(3)(z, weights).shape == (3, 18)
    assert np.allclose(networks.down_up_net(3)(z, weights)[1:2], networks.down_up_net(3)(z[1:2], weights))
