"""What larger tables brought up: ties, plans without a step that grows, groups that one task can't hold."""

from collections import Counter

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewave.operators import beats, colour, datasets, relational, studies
from tidewave.operators.waves import to_length, upsampled
from tidewave.plans import QUERIES
from tidewave.sources import tables
from tidewave.sources.tables import cut_beats

SMALL = "/root/testdata/sf0.001"


def test_of_two_beats_each_is_usual(spark):
    stats = [(k, b, a + b * (0.1 + k / 7), 5 + b, 0.3 * b + k / 3) for k in range(200) for b, a in ((1, 0.7), (2, 0.2))]
    x = spark.createDataFrame(stats, "k long, beat long, area double, duration long, amplitude double")
    assert beats.usual(x).count() == len(stats)


def test_two_beats_of_a_study_are_usual(spark):
    rows = []
    for k in range(60):
        t = 0
        for a, z in ((3, 5), (9 + k % 5, 14), (12, 13 + k % 7), (6, 4)):
            for i in range(a + z):
                t += 1
                rows.append((k, t, i / (3.1 + k / 9) if i < a else (a + z - i) / (5.3 + k / 11)))
    x = spark.createDataFrame(rows, "k long, t long, v double")
    told = studies.segments(x, 30.0, 3)
    two = told.withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n = 2")
    assert two.count() >= 40 and two.where("not accepted_area").count() == 0


def test_no_task_holds_a_recording(spark):
    rows = [(k % 2, k, t, float(t % 7 + k), float(t % 5 + k), float(t % 3 + k)) for k in range(64) for t in range(1, 30)]
    x = spark.createDataFrame(rows, "rec long, k long, t long, r double, g double, b double").repartition(4, "rec", "k")
    size = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for f in (colour.to_shortest, colour.hemo, colour.skin_flat, colour.lgi_global):
        found = f(x, recording="rec")
        assert found.count() == len(rows) and size(found) < len(rows) / 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)


def test_beats_are_compared_without_joins_of_their_samples(spark):
    for name, most in (("waveform_quality", 1), ("study_beat_contours", 0)):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= most, name


def test_likeness_of_whole_beats_is_that_of_their_samples(spark):
    rows = [(k, b, t, float((t * 7 + k * b) % 11)) for k in (1, 2) for b, t in [(1 + t // 12, t) for t in range(60)] if not (k == 2 and b == 3)]
    x = spark.createDataFrame(rows, "k long, beat long, t long, v double")
    even = upsampled(x, 20, ("k", "beat"), "t").withColumnRenamed("i", "pos")
    want = {(r.k, r.beat): r.sqi and round(r.sqi, 9) for r in beats.quality(even).collect()}
    assert {(r.k, r.beat): r.sqi and round(r.sqi, 9) for r in beats.alike(beats.whole_beats(x), 20).collect()} == want


def test_pairs_of_a_crowded_stem_are_many_tasks(spark):
    rows = [(i, f"d{i % 3}/{'many' if i % 10 else f'n{i // 20}'}.csv") for i in range(400)]
    files = spark.createDataFrame(rows, "id long, path string")
    left, right = files.where("id % 2 = 0"), files.where("id % 4 > 0")
    stem = {i: p.split("/")[1][:-4] for i, p in rows}
    want = Counter((stem[i], p, q) for i, p in rows if i % 2 == 0 for j, q in rows if j % 4 > 0 and stem[i] == stem[j])
    for side in (7, 1_000):
        assert Counter(map(tuple, relational.pairs_by_stem(left, right, "path", ("id",), side).collect())) == want
    found = relational.pairs_by_stem(left, right, "path", ("id",), 7)
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < sum(want.values()) / 2


def test_beats_of_few_labels_are_many_tasks(spark):
    rows = spark.createDataFrame([(i * 7919 % 1009, i % 3 or None) for i in range(1009)], "id long, label long")
    want = {r.id: r.n for r in rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).collect()}
    assert {r.id: r["rank"] for r in relational.rank_within(rows, "label", F.col("id"), parts=8, per_part=4).collect()} == want
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = cut_beats(spark, "/root/testdata/sf0.01").withColumn("task", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("task").alias("n")).agg(F.min("n")).first()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
    assert tasks == 4


def test_third_derivatives_of_a_batch_go_together():
    y = np.random.RandomState(4).rand(40, 9)
    y = to_length(y, np.full(len(y), 9), 200)
    one_by_one = [beats.derivative_waves(x, 200.0) for x in y]
    assert sum(x is not None for x in one_by_one) > 5 and repr(beats.waves_of(y, 200.0)) == repr(one_by_one)


def test_tasks_of_series_are_as_many_as_their_rows_ask_for(spark, monkeypatch):
    whole = tables.colour_traces(spark, SMALL)
    want = Counter(map(tuple, whole.collect()))
    monkeypatch.setattr(tables, "ROWS", 200)
    more = tables.colour_traces(spark, SMALL)
    assert more.rdd.getNumPartitions() == -(-sum(want.values()) // 200)
    assert Counter(map(tuple, more.collect())) == want


def test_aligned_sources_are_summed_without_copies(spark):
    rows = [("a", 1, 1, 5.0), ("a", 1, 2, None), ("a", 1, 3, 7.0), ("b", 1, 1, 2.0), ("b", 1, 2, 3.0), ("b", 2, 1, 4.0)]
    x = spark.createDataFrame(rows, "name string, k long, t long, v double")
    found = datasets.aligned({n: x.where(F.col("name") == n).drop("name") for n in "ab"})
    plan = found._jdf.queryExecution().executedPlan().toString()  # before it runs, after which it is told twice
    assert plan.count("HashAggregate") == 2
    assert sorted(map(tuple, found.collect())) == [(1, 1, 5.0, 2.0), (1, 2, None, 3.0)]
