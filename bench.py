"""Headline queries timed on one machine; prints one JSON line."""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ("pulse_chrom", "pulse_pos", "pulse_omit", "pulse_pbv", "rgb_fill_nan", "sig_asof_forward", "sig_peaks", "win_sliding_z", "beat_select_1sigma", "sqi_ranges", "beat_contour", "pivot_channels", "eval_bhs", "filt_chain", "pulse_ica", "sig_upsample_cubic", "natural_sort", "onsets", "waveform_quality", "dtw")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    top = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.local.dir": top, "spark.checkpoint.dir": f"{top}/shared"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tidewave.plans import QUERIES

    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
