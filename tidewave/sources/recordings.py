"""Folders of recordings as they lie: text files of any delimiter, headed or not, columns in any order, and .npy arrays.

What a file is like is told from its first line, one small row a file; the lines of all files then go through one scan, each
split at its own file's delimiter. Cells that hold text where a number belongs are null and `bad`; `unreadable` counts them.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.operators.relational import global_rank, natural_key
from tidewave.sources.files import TIME_NAMES, VALUE_NAMES, find_files, seconds

#: Files whose first lines are broadcast to the lines; more are joined by a shuffle.
BROADCAST_FILES = 100_000
#: Samples that a task gives out at a time.
SAMPLES = 1 << 16


def _first_of(names: Column, wanted: tuple[str, ...]) -> Column:
    """Place (from 0) of the first wanted name; null if there is none."""
    return F.coalesce(*[F.nullif(F.array_position(names, w), F.lit(0)) for w in wanted]) - 1


def forms(lines: DataFrame, fallback: str = "last") -> DataFrame:
    """file, begin (its first line's place), sep, headed, time_at and value_at of each file in `lines` (file, place, value).

    The delimiter is a comma, a tab or a semicolon if the first line holds one, else white space. A line is a header if one
    of its cells isn't a number. The value's column goes by name, else it is the last one, or with fallback "first" the first
    that isn't the time's. Without a header the first of several columns is the time.
    """
    line = F.regexp_replace(F.col("value"), "^﻿", "")
    first = lines.where(F.trim("value") != "").groupBy("file").agg(F.min("place").alias("begin"), F.min_by(line, "place").alias("line"))
    sep = F.when(F.col("line").contains(","), ",").when(F.col("line").contains("\t"), "\t").when(F.col("line").contains(";"), ";").otherwise(r"\s+")
    split = first.withColumn("sep", sep).withColumn("cells", F.transform(F.split(F.trim("line"), F.col("sep")), lambda c: F.lower(F.trim(F.regexp_replace(c, "^\\s*[\"']|[\"']\\s*$", "")))))
    headed = F.exists("cells", lambda c: c.try_cast("double").isNull())
    told = split.withColumn("headed", headed).withColumn("n", F.size("cells"))
    time = F.when(F.col("headed"), _first_of(F.col("cells"), TIME_NAMES)).when(F.col("n") > 1, F.lit(0))
    told = told.withColumn("time_at", time.cast("int"))
    other = F.when(F.col("time_at") == 0, F.least(F.lit(1), F.col("n") - 1)).otherwise(F.lit(0)) if fallback == "first" else F.when(F.col("time_at") == F.col("n") - 1, F.greatest(F.col("n") - 2, F.lit(0))).otherwise(F.col("n") - 1)
    value = F.coalesce(F.when(F.col("headed"), _first_of(F.col("cells"), VALUE_NAMES)), other)
    return told.select("file", "begin", "sep", "headed", "time_at", value.cast("int").alias("value_at"))


def parsed(lines: DataFrame, fallback: str = "last", broadcast_files: int = BROADCAST_FILES) -> DataFrame:
    """file, row (from 0), time_sec, value, bad for lines (file, place, value) of many files; place orders a file's lines. Blank lines are left out."""
    kinds = forms(lines, fallback)
    if kinds.count() <= broadcast_files:
        kinds = F.broadcast(kinds)
    rows = lines.join(kinds, "file").where((F.trim("value") != "") & ((F.col("place") > F.col("begin")) | ~F.col("headed")))
    cells = rows.select("file", "place", F.split(F.trim(F.regexp_replace("value", "^﻿", "")), F.col("sep")).alias("cells"), "time_at", "value_at")
    cell = lambda at: F.nullif(F.trim(F.regexp_replace(F.get("cells", F.col(at)), "^\\s*[\"']|[\"']\\s*$", "")), F.lit(""))
    texts = cells.select("file", "place", cell("time_at").alias("t"), cell("value_at").alias("v"))
    told = texts.select("file", "place", seconds(F.col("t")).alias("time_sec"), F.col("v").try_cast("double").alias("value"), "t", "v")
    bad = (F.col("t").isNotNull() & F.col("time_sec").isNull()) | (F.col("v").isNotNull() & F.col("value").isNull())
    order = Window.partitionBy("file").orderBy("place")
    return told.select("file", (F.row_number().over(order) - 1).cast("long").alias("row"), "time_sec", "value", bad.alias("bad"))


def read_texts(spark: SparkSession, path: str | list[str], fallback: str = "last") -> DataFrame:
    """parsed() of the .csv and .txt files below a folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,txt,CSV,TXT}").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return parsed(raw.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value"), fallback)


def read_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, row, time_sec (null), value, bad of the .npy files below a folder: a flat array each; one bad row for a file that isn't."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path).select(F.col("path").alias("file"), "content")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                try:
                    v = np.load(io.BytesIO(content.as_py()), allow_pickle=False).squeeze().astype(float)
                except (ValueError, EOFError, OSError):
                    v = np.zeros((0, 0))
                bad = v.ndim > 1
                v = np.full(1, np.nan) if bad else np.atleast_1d(v)
                for at in range(0, len(v), SAMPLES):
                    part = v[at : at + SAMPLES]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.arange(at, at + n)), pa.nulls(n, pa.float64()), pa.array(part, mask=~np.isfinite(part)), pa.array(np.full(n, bad))], ["file", "row", "time_sec", "value", "bad"])

    return raw.mapInArrow(run, "file string, row long, time_sec double, value double, bad boolean")


def read_recordings(spark: SparkSession, path: str | list[str], fallback: str = "last") -> DataFrame:
    """All readable files below a folder: file, row, time_sec, value, bad."""
    return read_texts(spark, path, fallback).unionByName(read_arrays(spark, path))


def unreadable(rows: DataFrame) -> DataFrame:
    """file, bad: how many rows of a file hold text where a number belongs; only files with some."""
    return rows.groupBy("file").agg(F.count_if("bad").alias("bad")).where("bad > 0")


def list_recordings(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("csv", "txt", "npy")) -> DataFrame:
    """path, place (from 0) of the files below a folder in natural order of their paths: runs of digits by their value. Empty files are left out."""
    names = find_files(spark, path, extensions)
    return global_rank(names, F.concat(natural_key(F.col("path")), F.lit("\0"), F.col("path")), "place")
