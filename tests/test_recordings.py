"""Recordings as they lie in folders, and operators that work by recording, by beats with margins and by blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import beats, colour, filters, relational
from tidewave.plans import QUERIES
from tidewave.sources import recordings

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("mixed")
    (top / "deep").mkdir()
    (top / "a.csv").write_text("time_sec,pulse\n0.0,1.5\n0.1,2.5\n")
    (top / "b.csv").write_text("﻿Value;other;Timestamp\n3.5;x;0:00:01.5\n4.5;y;0:00:02\n")
    (top / "deep" / "c.txt").write_text("0.0\t7\n\n0.5\t8\n1.0\tnine\n")
    (top / "d.txt").write_text("5\n6\n")
    (top / "e.txt").write_text("t  noise  level\n0  1  2\n1  3  4\n")
    (top / "f.csv").write_text('"pulse","time"\n"1","2"\n,3\n4\n')
    (top / "empty.csv").write_text("")
    (top / "head.csv").write_text("time_sec,pulse\n")
    np.save(top / "g.npy", np.array([[1.0], [2.0], [np.nan]]))
    np.save(top / "h.npy", np.zeros((2, 2)))
    (top / "i.npy").write_bytes(b"nothing")
    return str(top)


def test_mixed_folder(spark, folder):
    rows = recordings.read_recordings(spark, folder)
    got = {}
    for r in rows.orderBy("file", "row").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.row, r.time_sec, r.value, r.bad))
    assert got == {
        "a.csv": [(0, 0.0, 1.5, False), (1, 0.1, 2.5, False)],
        "b.csv": [(0, 1.5, 3.5, False), (1, 2.0, 4.5, False)],
        "c.txt": [(0, 0.0, 7.0, False), (1, 0.5, 8.0, False), (2, 1.0, None, True)],
        "d.txt": [(0, None, 5.0, False), (1, None, 6.0, False)],
        "e.txt": [(0, 0.0, 2.0, False), (1, 1.0, 4.0, False)],
        "f.csv": [(0, 2.0, 1.0, False), (1, 3.0, None, False), (2, None, 4.0, False)],
        "g.npy": [(0, None, 1.0, False), (1, None, 2.0, False), (2, None, None, False)],
        "h.npy": [(0, None, None, True)],
        "i.npy": [(0, None, None, True)],
    }
    bad = {r.file.rsplit("/", 1)[1]: r.bad for r in recordings.unreadable(rows).collect()}
    assert bad == {"c.txt": 1, "h.npy": 1, "i.npy": 1}
    first = {r.file.rsplit("/", 1)[1]: r.value for r in recordings.read_texts(spark, folder, "first").where("row = 0").collect()}
    assert first["e.txt"] == 1.0 and first["a.csv"] == 1.5


def test_a_file_of_many_splits_keeps_its_order(spark, tmp_path):
    (tmp_path / "long.csv").write_text("pulse,time\n" + "".join(f"{i * 2},{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = recordings.read_texts(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        assert rows.where("bad or value <> 2 * row or time_sec <> row").count() == 0 and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_recordings_do_not_touch_each_other(spark):
    rows = [(rec, 10 * rec + k, t, *(rec * c + 3.0 * k + (7 * t * (k + 1)) % 5 for c in (1.0, 2.0, 3.0))) for rec, n in ((1, 40), (2, 25)) for k in range(3) for t in range(1, n + k)]
    rows = [(rec, k, t, *(c / 255 for c in x)) if rec == 2 else (rec, k, t, *(40 + c for c in x)) for rec, k, t, *x in rows]
    both = spark.createDataFrame(rows, "rec long, k long, t long, r double, g double, b double")
    short = colour.to_shortest(both, "rec")
    assert {(r.rec, r.n) for r in short.groupBy("rec", "k").agg(F.max("t").alias("n")).collect()} == {(1, 39), (2, 24)}
    for f in (lambda x, **kw: colour.hemo(x, False, **kw), colour.skin_flat, colour.lgi_global):
        got = {(r.k, r.t): tuple(r)[3:] for r in f(short, recording="rec").collect()}
        want = {}
        for rec in (1, 2):
            want |= {(r.k, r.t): tuple(r)[2:] for r in f(short.where(F.col("rec") == rec).drop("rec")).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], atol=1e-9) for x in got)
    assert exchanges(QUERIES["rgb_min_length_by_recording"](spark, SMALL)) == 1
    assert exchanges(QUERIES["pulse_skin_flat_by_recording"](spark, SMALL)) == 1


def test_boxes_and_polygons_need_no_loop_join(spark):
    for name in ("roi_box_means", "roi_polygon_means"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_polygon_spans_equal_a_test_of_every_pixel(spark):
    rng = np.random.RandomState(1)
    shapes = [("s%d" % i, [tuple(int(c) for c in p) for p in rng.randint(0, 12, (n, 2))]) for i, n in enumerate((3, 4, 5, 6, 1, 2))]
    corners = spark.createDataFrame([(0, roi, i, x, y) for roi, c in shapes for i, (x, y) in enumerate(c)], "frame long, roi string, i int, x long, y long")
    got = {(r.roi, x, r.y) for r in colour.polygon_spans(corners).collect() for x in range(r.x0, r.x1 + 1)}
    want = set()
    for roi, c in shapes:
        edges = list(zip(c, c[1:] + c[:1]))
        for x in range(12):
            for y in range(12):
                crossings = sum((a[1] <= y) != (b[1] <= y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges)
                border = any((b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0]) and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]) for a, b in edges)
                if crossings % 2 or border:
                    want.add((roi, x, y))
    assert got == want


def wave(n, rate=30.0):
    t = np.arange(n) / rate
    return np.sin(2 * np.pi * 1.1 * t) + 0.3 * np.sin(2 * np.pi * 2.2 * t + 0.5) + 0.2 * np.sin(2 * np.pi * 0.05 * t)


def test_beats_with_margins_equal_slices(spark):
    v = wave(400)
    x = spark.createDataFrame([(1, i + 1, float(y)) for i, y in enumerate(v)], "k long, t long, v double")
    reach = 5
    low = [i for i in range(reach, 400 - reach) if all(v[i] < v[j] for j in range(i - reach, i + reach + 1) if j != i)]
    for margin in (0, 4, 40):  # 40: longer than a beat
        want = {n + 1: v[a - margin : b].tolist() for n, (a, b) in enumerate(zip(low, low[1:])) if a >= margin}
        got = {}
        for r in beats.cut_with_margin(x, reach, margin).orderBy("beat", "pos").collect():
            got.setdefault(r.beat, []).append(r.v)
        assert got == want
    cut = beats.cut_with_margin(x, reach, 4)
    flat = {(r.beat, r.pos): r.v for r in beats.without_margin_chord(cut, 4).collect()}
    y = np.array(v[low[1] - 4 : low[2]])
    y[4:] -= np.linspace(y[4], y[-1], len(y) - 4)
    assert np.allclose([flat[2, i] for i in range(len(y))], y)


def plain_onsets(x, rate):
    slope, out = np.gradient(x) if len(x) > 1 else np.zeros(1), []
    for i in np.flatnonzero((x[:-1] < 0) & (x[1:] >= 0)):
        low, high = max(0, i - int(0.2 * rate)), min(len(x) - 1, i + int(0.2 * rate))
        top = low + int(np.argmax(slope[low : high + 1]))
        begin = max(0, i - int(0.4 * rate))
        trough = begin + int(np.argmin(x[begin : i + 1]))
        if slope[top] * rate <= 1e-6:
            continue
        foot = int(np.clip(round(top + (x[trough] - x[top]) / slope[top]), 0, len(x) - 1))
        if not out or foot - out[-1] >= int(0.3 * rate):
            out.append(foot)
    return out


def test_onsets_equal_the_loop_without_python(spark):
    rng = np.random.RandomState(4)
    series = {1: wave(500), 2: rng.normal(size=400), 3: np.ones(50), 4: -np.ones(1), 5: np.cumsum(rng.normal(size=300))}
    x = spark.createDataFrame([(k, i + 1, float(v)) for k, y in series.items() for i, v in enumerate(y)], "k long, t long, v double")
    found = filters.onsets(x, 30.0)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("k", "beat").collect():
        got.setdefault(r.k, []).append(r.t - 1)
    assert got == {k: o for k, y in series.items() if (o := plain_onsets(np.asarray(y), 30.0))}


def test_blocks_equal_the_whole_series(spark):
    n = 200_000
    x = spark.range(n).selectExpr("1L as k", "id + 1 as t", "sin(id / 4.3) + 0.5 * sin(id / 2.1) + id / 20000 + 0.3 * sin(id / 900) as v")
    steps = [filters.detrend(30.0), filters.bandpass(0.75, 3.0, 30.0)]
    some = "t % 997 = 0 or t < 200 or t > 199800"
    parts = filters.apply_blocks(x, steps, 20_000, 3_000)
    got = np.asarray([r.v for r in parts.where(some).orderBy("t").collect()])
    want = np.asarray([r.v for r in filters.apply_chain(x, steps).where(some).orderBy("t").collect()])
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-6
    assert parts.count() == n and parts.select(F.spark_partition_id()).distinct().count() > 1


def test_the_rank_key_is_computed_once_a_row(spark):
    plan = QUERIES["natural_sort"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2 and "<= array_join" not in plan  # once to rank, once to count
    x = spark.createDataFrame([(i, None if i % 50 == 0 else f"n{(i * 37) % 499:03d}_{i}") for i in range(1, 400)], "i long, name string")
    got = [r.i for r in relational.global_rank(x, F.col("name"), "n", 8, 4).where("name is not null").orderBy("n").collect()]
    assert got == [i for i, _ in sorted(((i, f"n{(i * 37) % 499:03d}_{i}") for i in range(1, 400) if i % 50), key=lambda p: p[1])]


def test_quality_of_a_steady_wave(spark):
    x = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate(wave(900))], "k long, t long, v double")
    told = beats.waveform_quality(x, 30.0).orderBy("beat").collect()
    assert len(told) > 25 and sum(r.good for r in told) > 0.8 * len(told) and not told[-1].good
    assert all(abs(a.end - b.start) < 1e-9 for a, b in zip(told, told[1:]))
    assert len(beats.good_times(beats.waveform_quality(x, 30.0)).collect()) >= 1


def test_files_are_laid_out_anew(spark, tmp_path):
    from tidewave.sources import layout

    top = tmp_path / "old"
    for name, text in {"ICA/001_before_cheek.csv": "a", "ICA/002-after-chin.csv": "bb", "POS/readme.csv": "c", "POS/003before_nose.csv": "dddd"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    names = spark.createDataFrame([(str(p.relative_to(top)),) for p in top.rglob("*.csv")], "path string")
    moves = layout.by_method_and_region(names)
    assert {r.source: r.target for r in moves.collect()} == {"ICA/001_before_cheek.csv": "ICA_cheek_before/001.csv", "ICA/002-after-chin.csv": "ICA_chin_after/002.csv", "POS/readme.csv": None, "POS/003before_nose.csv": "POS_nose_before/003.csv"}
    new = tmp_path / "new"
    for _ in range(2):  # a second run leaves the same files
        copied = {r.target: r.bytes for r in layout.copy_files(spark, moves, str(top), str(new)).collect()}
    assert copied == {"ICA_cheek_before/001.csv": 1, "ICA_chin_after/002.csv": 2, "POS_nose_before/003.csv": 4}
    assert {str(p.relative_to(new)): p.read_text() for p in new.rglob("*.csv")} == {"ICA_cheek_before/001.csv": "a", "ICA_chin_after/002.csv": "bb", "POS_nose_before/003.csv": "dddd"}
    assert len(list(top.rglob("*.csv"))) == 4
    two = spark.createDataFrame([("a/1_x_y.csv",), ("a/1-x-y.csv",)], "path string")
    assert [(r.target, r.n) for r in layout.clashes(layout.by_method_and_region(two)).collect()] == [("a_y_x/1.csv", 2)]


def test_three_stages_share_a_time_axis(spark):
    from tidewave.sources import layout

    x = spark.createDataFrame([("s", 1, None, 1.0, 2.0, 3.0), ("s", 2, None, 4.0, None, 6.0), ("u", 1, 0.5, 7.0, 8.0, None)], "stem string, t long, time_sec double, given double, `true` double, predicted double")
    got = {(r.stem, r.stage, r.t): (r.time_sec, r.pulse) for r in layout.three_stages(x).collect()}
    assert got == {("s", "rppg_input", 1): (0.0, 1.0), ("s", "ppg_true", 1): (0.0, 2.0), ("s", "ppg_pred", 1): (0.0, 3.0), ("u", "rppg_input", 1): (0.5, 7.0), ("u", "ppg_true", 1): (0.5, 8.0), ("u", "ppg_pred", 1): (0.5, None)}


def test_splines_go_on_to_whole_seconds(spark):
    from tidewave.operators import waves

    at = [0.4, 1.1, 1.1, 2.0, 3.7, 4.2]
    x = spark.createDataFrame([(1, t, t**3 - 2 * t + (5.0 if i == 2 else 0.0)) for i, t in enumerate(at)] + [(2, 0.2, 1.0)], "k long, sec double, v double")
    got = [r.v for r in waves.at_times(x, "sec", 2.0, True).where("k = 1").orderBy("i").collect()]
    grid = np.linspace(0, 4, 8)
    assert np.allclose(got, grid**3 - 2 * grid)  # a cubic is its own spline, before the first sample too
    assert waves.at_times(x, "sec", 2.0, True).where("k = 2").count() == 0


def test_envelope_times_normal_is_the_signal(spark):
    from tidewave.operators import waves

    v = wave(301)
    x = spark.createDataFrame([(1, i + 1, float(y)) for i, y in enumerate(v)] + [(2, 1, 0.0)], "k long, t long, v double")
    rows = waves.over_envelope(x).where("k = 1").orderBy("i").collect()
    assert np.allclose([r.v * r.envelope for r in rows], v) and max(abs(r.v) for r in rows) <= 1 + 1e-9
    assert [tuple(r) for r in waves.over_envelope(x).where("k = 2").collect()] == [(2, 0, 0.0, 1e-8)]


def test_a_recording_spread_over_batches_is_computed_whole(spark, tmp_path):
    from tidewave.operators import signal
    from tidewave.streaming import batches

    rows = [(k, t, float((t * 7 * k) % 13), 40) for k in (1, 2, 3) for t in range(1, 41)]
    df = spark.createDataFrame(rows, "k long, t long, v double, n long")
    places = [str(tmp_path / x) for x in ("in", "out", "cp")]
    cuts = ["k = 1 and t > 25", "(k = 1 and t <= 25 and t > 3) or (k = 2 and t % 2 = 0)", "k = 1 and t <= 4 or k = 2 and t % 2 = 1", "k = 3 and t < 40"]
    seen = []
    for cut in cuts:
        df.where(cut).coalesce(1).write.mode("append").parquet(places[0])
        batches.follow_whole(spark, places[0], df.schema, signal.reversed_signal, places[1], places[2], "n").awaitTermination(120)
        seen.append(sorted({r.k for r in spark.read.parquet(places[1]).collect()}) if (tmp_path / "out").exists() and any((tmp_path / "out").rglob("*.parquet")) else [])
    assert seen == [[], [], [1, 2], [1, 2]]  # the third recording still lacks its last sample
    got = {(r.k, r.t): r.v for r in spark.read.parquet(places[1]).collect()}
    want = {(r.k, r.t): r.v for r in signal.reversed_signal(df.where("k < 3")).collect()}
    assert got == want


def test_features_of_a_mean_shape(spark):
    from tidewave.operators import studies

    t = np.arange(1500) / 30.0
    phase = (t * 1.0) % 1.0
    shape = np.exp(-((phase - 0.25) ** 2) / 0.008) + 0.45 * np.exp(-((phase - 0.55) ** 2) / 0.012)
    x = spark.createDataFrame([(k, i + 1, float(k * y + 0.001 * np.sin(i))) for k in (1, 2) for i, y in enumerate(shape)], "k long, t long, v double")
    every = beats.cut_with_margin(x, 10, 4).select("k", "beat").distinct()
    told = {r.k: r for r in studies.representative_features(x, every, 10, 4, 90).collect()}
    assert set(told) == {1, 2} and told[1].beats > 40
    for k, r in told.items():
        assert 15 < r.cn_t1 < 40 and 0 < r.cn_systolic_share < 1 and r.cn_width50 < r.cn_width25
        y = [p.v for p in studies.from_first_valley(studies.mean_shape(x, every, 10, 4, 90)).where(F.col("k") == k).orderBy("pos").collect()]
        want = beats.derivative_waves(np.asarray(y), 90.0)
        assert np.allclose([r[f"dr_{c}"] for c in beats.WAVES if r[f"dr_{c}"] is not None], [v for c, v in zip(beats.WAVES, want, strict=True) if r[f"dr_{c}"] is not None])
    one = studies.mean_shape(x, every, 10, 0, 90).groupBy("k").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).collect()
    assert all(r.n == 90 and r.low > -1e-9 and 1.5 < r.high < 2 + 1e-9 for r in one)
    good = studies.accepted_with_margin(x, 10, 4)
    assert good.join(every, ["k", "beat"], "left_anti").count() == 0


def test_study_tables_hang_together(spark):
    from tidewave.operators import studies

    v = wave(900)
    x = spark.createDataFrame([(1, i + 1, float(y)) for i, y in enumerate(v)], "k long, t long, v double")
    mean, each, told = studies.study_features(studies.normal_wave(x, 30.0), 30.0, 8, 120)
    rows = {r.beat: r for r in told.collect()}
    assert len(rows) > 25 and all(r.end > r.start and r.n == round((r.end - r.start) * 30) for r in rows.values())
    assert all(r.quality == (r.sqi is not None and r.sqi >= 0.3 and r.sqi_wave >= 0.3) for r in rows.values())
    found = each.collect()
    assert all(rows[r.beat].quality and r.start == rows[r.beat].start for r in found)
    total = mean.collect()
    assert not found or (total[0].beats == len(found) and np.isclose(total[0].cn_t1, np.mean([r.cn_t1 for r in found])))
    grid = studies.resized(spark.createDataFrame([(1, 1, i, float(i * i)) for i in range(7)] + [(1, 2, 0, 5.0)], "k long, beat long, pos long, v double"), 11)
    assert np.allclose([r.v for r in grid.orderBy("pos").collect()], np.interp(np.linspace(0, 6, 11), np.arange(7), np.arange(7) ** 2))


def test_files_are_listed_in_natural_order(spark, tmp_path):
    for name in ("img10.csv", "img9.csv", "img010.csv", "b/Img2.txt", "b/img1.npy", "note.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    got = [r.path.split(f"{tmp_path}/")[1] for r in recordings.list_recordings(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == ["b/img1.npy", "b/Img2.txt", "img9.csv", "img010.csv", "img10.csv"]
