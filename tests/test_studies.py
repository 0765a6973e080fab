"""Sinks, manifests and folders read back; regression against closed forms; ranks, missing sources and checks on small rows."""

import pytest
from pyspark.sql import functions as F

from tidewave.operators import beats, regression, relational, signal
from tidewave.sources import files


def test_predictions_and_logs_are_read_back(spark, tmp_path):
    rows = [("a", t, t / 10, 1.0 + t, 2.0 - t) for t in range(12)] + [("b", 0, 0.0, 1 / 3, -1 / 3)]
    x = spark.createDataFrame(rows, "stem string, t long, time_sec double, y_true double, y_pred double")
    files.write_predictions(x, str(tmp_path / "p"), "stem")
    text = next((tmp_path / "p" / "stem=a").glob("*.csv")).read_text().splitlines()
    assert text[0] == "time_sec,y_true,y_pred" and text[1] == "0.0000000,1.0000000,2.0000000" and text[11].startswith("1.0000000,")
    files.write_predictions(x, str(tmp_path / "q"), "stem", None)
    assert next((tmp_path / "q" / "stem=b").glob("*.csv")).read_text().splitlines() == ["index,y_true,y_pred", "0.0000000,0.3333333,-0.3333333"]
    for epoch in (1, 2):
        files.log_rows(spark, str(tmp_path / "log"), [{"epoch": epoch, "loss": 0.5}], "epoch int, loss double")
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2


def test_manifests_for_new_subjects(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"subject_id": "1", "roi_name": "x", "paths": {"lgi": "/d/deep-learning-dataset/LGI_x/1.csv", "ppg": "/e/f/1.csv"}, "meta": {"bp": [120, 80]}}')
    made = files.new_manifests(files.read_manifests(spark, str(tmp_path / "m.json")), spark.createDataFrame([("7",), ("8",)], "subject_id string"), "cheek")
    got = {r.subject_id: r for r in made.collect()}
    assert got["7"].paths == {"lgi": "/d/deep-learning-dataset/LGI_cheek/7.csv", "ppg": "/e/f/PPG_before/7.csv"} and got["8"].roi_name == "cheek" and got["8"].meta.fs_rppg == 30
    files.write_manifests(made, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_folders_are_found_by_their_names(spark, tmp_path):
    for name in ("s1/rPPG-pulse/CHROM", "s1/video", "s2/rppg-old"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "a.csv").write_text("x")
    found = lambda **k: sorted(r.folder for r in files.find_folders(spark, str(tmp_path), **k).collect())
    assert found() == ["s1", "s1/rPPG-pulse", "s1/rPPG-pulse/CHROM", "s1/video", "s2", "s2/rppg-old"]
    assert found(any_of=("RPPG",), none_of=("old",)) == ["s1/rPPG-pulse"]


def test_predictions_out_of_fold(spark):
    rows = [(i, i % 3, float(i), None if i % 10 == 0 else float(i % 7), 2.0 * i + 3 * (i % 7)) for i in range(90)]
    x = spark.createDataFrame(rows, "row long, fold int, a double, b double, y double")
    assert regression.medians(x, ["a", "b"]) == {"a": 44.5, "b": 3.0}
    told = regression.out_of_fold(x, ["a", "b"], "y", "linear")
    assert told.count() == 90 and told.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 2
    best, error = regression.tuned(x, ["a", "b"], "y", "linear", {"regParam": [1000.0, 0.0]})
    assert best == {"regParam": 0.0} and error < 2


@pytest.mark.parametrize("n", [0, 1, 7, 5_000])
def test_ranks_over_ranges(spark, n):
    x = spark.range(n).withColumn("v", F.md5(F.col("id").cast("string")))
    got = {r.v: r["rank"] for r in relational.global_rank(x, F.col("v"), parts=8, per_part=4).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))} and len(got) == n


def test_keys_without_any_source_are_reported(spark):
    x = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "sid int, source string")
    assert {r.sid: r.missing for r in relational.missing_sources(x, ["a", "b"]).collect()} == {2: "a", 3: "a,b"}


def test_checks_of_beats(spark):
    pulse = [0, 3, 6, 9, 7, 5, 6, 4, 2, 1, 0]
    late = [0, 1, 2, 3, 4, 5, 6, 7, 9, 3, 0]
    double = [0, 3, 5, 4, 6, 8, 5, 3, 2, 1, 0]
    flat = [1] * 11
    shapes = {1: pulse, 2: late, 3: double, 4: flat}
    x = spark.createDataFrame([(1, b, p, float(v)) for b, s in shapes.items() for p, v in enumerate(s)], "k long, beat long, pos long, v double")
    assert {r.beat: r.good for r in beats.check_pulse(x).collect()} == {1: True, 2: False, 3: False, 4: False}
    second = [5, 0, -6, 1, 3, 0, -2, 0, 2, 0]
    y = spark.createDataFrame([(1, b, p, float(v)) for b, s in {1: [0, *second], 2: [0, *[-v for v in second]]}.items() for p, v in enumerate(s)], "k long, beat long, pos long, v double")
    assert {r.beat: r.good for r in beats.check_second_derivative(y).collect()} == {1: True, 2: False}


def test_heart_rate_and_noise_of_a_wave(spark):
    import math

    rows = [(1, t + 1, math.sin(2 * math.pi * 1.22 * t / 30)) for t in range(600)] + [(2, t + 1, 1.0 * t) for t in range(20)]
    x = spark.createDataFrame(rows, "k long, t long, v double")
    assert {r.k: r.bpm and round(r.bpm, 6) for r in signal.heart_rate_by_spectrum(x, 30.0).collect()} == {1: 72.0, 2: None}
    import numpy as np

    size = np.abs(np.fft.fft([v for k, _, v in rows if k == 1]))[:300]
    peak, reach = int(np.sort(np.argsort(size)[-2:])[0]), int(0.3 * 600 / 30)
    inside = sum(size[m * peak - reach : m * peak + reach + 1].sum() for m in (1, 2, 3))
    told = signal.signal_to_noise(x.where("k = 1"), 30.0).first()
    assert told.bin == peak and math.isclose(told.snr, 10 * math.log10(inside / (size.sum() - inside)), rel_tol=1e-6)
