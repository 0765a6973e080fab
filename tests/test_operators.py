"""Known answers, invariants and edge cases of the signal operators and readers."""

import numpy as np
import pytest

from tidewave.functions.windows import filled, series
from tidewave.operators import beats, colour, filters, metrics, relational, signal, splits
from tidewave.sources import files
from tidewave.streaming import batches
from pyspark.sql import functions as F

FPS = 30.0


@pytest.fixture(scope="module")
def traces(spark):
    t = np.arange(600)
    rows = []
    for k, gain in ((1, (1.0, 1.0, 1.0)), (2, (1.3, 0.7, 1.1))):
        wave = np.sin(2 * np.pi * 1.2 * t / FPS)
        for i in t:
            rows.append((k, int(i) + 1, *(float(g * (100 + a * wave[i] + 0.1 * (i % 7))) for g, a in zip(gain, (0.3, 0.8, 0.5), strict=True))))
    return spark.createDataFrame(rows, "k long, t long, r double, g double, b double")


def column(df, k, name="v"):
    return np.asarray([r[name] for r in df.where(F.col("k") == k).orderBy("t").collect()], float)


def test_pos_equals_the_loop_and_ignores_gain(traces):
    x = np.stack([column(traces, 1, c) for c in "rgb"])
    w, h = 48, np.zeros(600)
    for m in range(600 - w + 1):
        c = x[:, m : m + w]
        n = c / (c.mean(1, keepdims=True) + 1e-6)
        s1, s2 = n[1] - n[2], -2 * n[0] + n[1] + n[2]
        p = s1 + s1.std() / (s2.std() + 1e-6) * s2
        h[m : m + w] += p - p.mean()
    found = colour.pos(traces, FPS)
    assert np.allclose(column(found, 1), h, atol=1e-9) and np.allclose(column(found, 1), column(found, 2), atol=1e-4)


def test_methods_agree_with_numpy(traces):
    x = np.stack([column(traces, 1, c) for c in "rgb"])
    s = np.linalg.svd(x, full_matrices=False)[0][:, 0]
    assert np.allclose(column(colour.lgi(traces), 1), x[1] - s[1] * (s @ x), atol=1e-6)
    q = x[:, 0] / np.linalg.norm(x[:, 0])
    assert np.allclose(column(colour.omit(traces), 1), x[1] - q[1] * (q @ x), atol=1e-9)
    n = x / (x.mean(1, keepdims=True) + 1e-6)
    p = n.std(1) / (np.sqrt(n.var(1).sum()) + 1e-6)
    w = np.linalg.solve(n @ n.T + 1e-6 * np.eye(3), p)
    assert np.allclose(column(colour.pbv(traces), 1), n.T @ w / (p @ w + 1e-6), atol=1e-4)
    with pytest.raises(ValueError):
        colour.extract_pulse(traces, "NONE")
    for method in colour.METHODS:
        assert colour.extract_pulse(traces, method).where("v is not null").count() == 1200


def test_heart_rate_of_a_sine(spark):
    rows = [(1, i + 1, float(np.sin(2 * np.pi * 1.2 * i / FPS + 0.3))) for i in range(900)]
    x = spark.createDataFrame(rows, "k long, t long, v double")
    assert abs(signal.heart_rate(x, FPS, 10).first().bpm - 72) < 0.5


def test_filling_gaps(spark):
    rows = [(1, i + 1, v) for i, v in enumerate([None, 1.0, None, 3.0, None])] + [(2, 1, None), (2, 2, None)]
    x = spark.createDataFrame(rows, "k long, t long, v double").withColumn("v", filled("v", "t", series("k", "t")))
    assert column(x, 1).tolist() == [1, 1, 2, 3, 3] and column(x, 2).tolist() == [0, 0]


def test_forward_alignment_clamps(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 2.5), (1, 9.0)], "k long, sec double")
    right = spark.createDataFrame([(1, 0.5, 10.0), (1, 2.5, 20.0), (1, 3.0, 30.0)], "k long, sec double, v double")
    assert {r.sec: r.v for r in signal.aligned_forward(left, right).collect()} == {1.0: 20.0, 2.5: 20.0, 9.0: 30.0}


def test_windows_are_full(spark):
    x = spark.createDataFrame([(1, i + 1, float(i)) for i in range(25)], "k long, t long, v double")
    assert sorted({r.win for r in signal.windowed(x, 10, 5).collect()}) == [0, 1, 2, 3]
    assert sorted({r.win for r in signal.windowed(x, 10, 10).collect()}) == [0, 1]


def test_ranges_of_good_beats(spark):
    x = spark.createDataFrame([(1, i, c == "T") for i, c in enumerate("TTFTFFT")], "k long, beat long, good boolean")
    assert {(r["first"], r["last"]) for r in beats.ranges(x).collect()} == {(0, 1), (3, 3), (6, 6)}


def test_grades_at_their_bounds(spark):
    x = spark.createDataFrame([(1, 0.0, e) for e in (5.0, 10.0, 15.0)] + [(2, 1.0, 2.0)], "k long, y double, p double")
    wide, tight = ({r.k: r for r in metrics.bhs(x, ["k"], strict=s).collect()} for s in (False, True))
    assert (wide[1].within5, wide[1].within15) == (pytest.approx(1 / 3), 1.0) and tight[1].within5 == 0.0 and wide[2].grade == "A"
    assert {r.k: r.sd for r in metrics.aami(x, ["k"]).collect()}[2] == 0.0


def test_filters():
    t = np.arange(900) / FPS
    line = 3 + 2 * t
    assert np.abs(filters.detrend(FPS)(line)[:700]).max() < 0.3
    own = filters.bandpass(0.75, 3.0, FPS)
    kept = own(np.sin(2 * np.pi * 1.5 * t))[200:-200]
    assert np.abs(kept - np.sin(2 * np.pi * 1.5 * t)[200:-200]).max() < 0.02  # zero phase, unit gain
    assert np.abs(own(np.full(900, 5.0))).max() < 1e-6 and np.isnan(own(np.ones(5))).all()
    cubic = t**3 - t
    assert np.allclose(filters.savitzky_golay(FPS)(cubic), cubic)
    w = np.sin(2 * np.pi * t)
    assert np.allclose(np.abs(filters.by_envelope()(5 * w)), np.abs(w), atol=1e-6)
    for order in (1, 3, 5):
        b, a = filters._butterworth(order, 0.75, 3.0, FPS)
        gain = [abs(np.polyval(b, z) / np.polyval(a, z)) for z in np.exp(2j * np.pi * np.asarray([0.75, 3.0]) / FPS)]
        assert np.allclose(gain, 2**-0.5, atol=1e-6) and np.abs(np.roots(a)).max() < 1


def test_detrend_equals_the_dense_inverse():
    rng = np.random.RandomState(0)
    v = rng.randn(80).cumsum()
    p = np.concatenate([v, v[-12:]])
    d = np.diff(np.eye(len(p)), 2, axis=0)
    assert np.allclose(filters.detrend(6.0)(v), (p - np.linalg.inv(np.eye(len(p)) + 72.0**2 * d.T @ d) @ p)[:80])


def test_warping_distance():
    a = np.asarray([0.0, 1, 2, 3])
    assert filters.dtw(a, np.asarray([0.0, 0, 1, 2, 3])) == 0 and filters.dtw(a, a + 1, 0) == 2.0


def test_names(spark):
    x = spark.createDataFrame([("img10.png",), ("img9.png",), ("img1.png",)], "n string")
    assert [r.n for r in x.orderBy(relational.natural_key(F.col("n"))).collect()] == ["img1.png", "img9.png", "img10.png"]
    y = spark.createDataFrame([("a12_345_6",), ("x7",), ("none",)], "n string").select(relational.subject_id(F.col("n")).alias("s"))
    assert [r.s for r in y.collect()] == ["345", "7", None]


def test_splits_cover_everyone_once(spark):
    x = spark.range(50).select(F.col("id").alias("row"), (F.col("id") % 7).alias("subject"))
    parts = splits.three_way(x, "subject").collect()
    assert len(parts) == 50 and {r.part for r in parts} == {"train", "val", "test"} and len({(r.subject, r.part) for r in parts}) == 7
    assert len({r.fold for r in splits.loso(x, "subject").collect()}) == 7


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time_sec,Pulse\n0.0,1.5\n0.1,bad\n")
    rows = files.read_signal_csv(spark, str(tmp_path / "a.csv")).orderBy("time_sec").collect()
    assert [(r.time_sec, r.value) for r in rows] == [(0.0, 1.5), (0.1, None)] and rows[0].file.endswith("a.csv")
    (tmp_path / "b.PW").write_text("1.0 0:00:01.5\n\n2.0\n")
    assert sorted((r.value, r.time_sec) for r in files.read_pw(spark, str(tmp_path / "b.PW")).fillna(-1.0).collect()) == [(1.0, 1.5), (2.0, -1.0)]
    (tmp_path / "u.txt").write_text("1 2 3\n60 61 62\n0 0.1 0.2\n")
    assert [(r.trace, r.hr, r.time_sec) for r in files.read_ubfc_txt(spark, str(tmp_path / "u.txt")).orderBy("idx").collect()][2] == (3.0, 62.0, 0.2)
    (tmp_path / "u.xmp").write_text("<x>\n1000 60 0 5\n")
    assert files.read_ubfc_xmp(spark, str(tmp_path / "u.xmp")).first().time_sec == 1.0
    (tmp_path / "p.txt").write_text("1.5 x\nbad\n2\n")
    assert files.read_ppg_text(spark, str(tmp_path / "p.txt")).count() == 2
    (tmp_path / "m.json").write_text('{"subject_id": "7",\n "roi_name": "chin", "paths": {"pos": "x"}, "meta": {"bp": [120, 80]}}')
    m = files.read_manifests(spark, str(tmp_path / "m.json")).first()
    assert (m.fs_rppg, m.fs_ppg_src, m.detrend, m.bp) == (30, 100, True, [120.0, 80.0])
    assert files.find_files(spark, str(tmp_path), ("txt",), none_of=("u.",)).count() == 1


def test_following_files_as_they_come(spark, tmp_path):
    spark.createDataFrame([(1, 1, 2.0), (1, 2, 5.0)], "k long, t long, v double").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    batches.follow(spark, str(tmp_path / "in"), schema, signal.reversed_signal, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 3.0]
