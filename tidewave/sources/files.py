"""Readers and writers of the file forms that pulse recordings come in, all into one signal schema.

Every reader keeps the file's name in `file`; values that can't be read become null, never errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column names that files in the field carry, by preference.
TIME_NAMES = ("time_sec", "time", "t", "timestamp")
VALUE_NAMES = ("pulse", "ppg", "lgi", "rppg", "signal", "value", "y")
MANIFEST = "subject_id string, roi_name string, paths map<string,string>, meta struct<fs_rppg:int,fs_ppg_src:int,bp:array<double>,detrend:boolean>"


def file_name() -> Column:
    return F.col("_metadata.file_path").alias("file")


def seconds(text: Column) -> Column:
    """Seconds of a number or of h:m:s.f text."""
    parts = F.split(F.trim(text), ":")
    clock = F.get(parts, F.lit(0)).try_cast("double") * 3600 + F.get(parts, F.lit(1)).try_cast("double") * 60 + F.get(parts, F.lit(2)).try_cast("double")
    return F.coalesce(F.trim(text).try_cast("double"), clock)


def pick(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    """The first wanted name among the columns, whatever its case."""
    low = {c.lower().strip(): c for c in columns}
    return next((low[w] for w in wanted if w in low), None)


def read_signal_csv(spark: SparkSession, path: str, sep: str = ",", recursive: bool = False) -> DataFrame:
    """file, time_sec, value of CSV files with a header: names by preference, else the last column is the value."""
    raw = spark.read.option("header", True).option("sep", sep).option("recursiveFileLookup", recursive).csv(path)
    time, value = pick(raw.columns, TIME_NAMES), pick(raw.columns, VALUE_NAMES)
    value = value or next((c for c in reversed(raw.columns) if c != time), None)
    if value is None:
        raise ValueError(f"no value column among {raw.columns}")
    at = seconds(F.col(f"`{time}`")) if time else F.lit(None).cast("double")
    return raw.select(file_name(), at.alias("time_sec"), F.col(f"`{value}`").try_cast("double").alias("value"))


def read_ppg_text(spark: SparkSession, path: str) -> DataFrame:
    """The first token of each line, lines without a number left out."""
    return spark.read.text(path).select(file_name(), F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).try_cast("double").alias("value")).where("value is not null")


def read_pw(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a value and the rest as its time; blank lines left out, a line may lack the time."""
    line = F.trim("value")
    rows = spark.read.text(path).where(F.length(line) > 0)
    return rows.select(file_name(), F.regexp_extract(line, r"^(\S+)", 1).try_cast("double").alias("value"), seconds(F.nullif(F.regexp_extract(line, r"^\S+\s+(.*)$", 1), F.lit(""))).alias("time_sec"))


def read_ubfc_txt(spark: SparkSession, path: str) -> DataFrame:
    """Three lines (trace, heart rate, time) turned into rows by position."""
    whole = spark.read.text(path, wholetext=True).select(file_name(), F.split("value", "\n").alias("lines"))
    row = lambda i: F.split(F.trim(F.get("lines", F.lit(i))), r"\s+")
    rows = whole.select("file", row(1).alias("hrs"), row(2).alias("times"), F.posexplode(row(0)).alias("idx", "trace"))
    return rows.select("file", "idx", F.col("trace").try_cast("double").alias("trace"), F.get("hrs", F.col("idx")).try_cast("double").alias("hr"), F.get("times", F.col("idx")).try_cast("double").alias("time_sec"))


def read_ubfc_xmp(spark: SparkSession, path: str) -> DataFrame:
    """Columns time in ms, heart rate, unused, trace; lines that begin with < are comments."""
    parts = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return spark.read.text(path).where(~F.trim("value").startswith("<")).select(file_name(), (at(0) / 1000).alias("time_sec"), at(1).alias("hr"), at(3).alias("trace")).where("time_sec is not null")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Subject manifests with the defaults of missing settings: 30 and 100 frames a second, detrend."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return rows.select("subject_id", "roi_name", "paths", F.coalesce("meta.fs_rppg", F.lit(30)).alias("fs_rppg"), F.coalesce("meta.fs_ppg_src", F.lit(100)).alias("fs_ppg_src"), F.col("meta.bp").alias("bp"), F.coalesce("meta.detrend", F.lit(True)).alias("detrend"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumnRenamed("subject", "subject_id") if "subject_id" not in raw.columns else raw
    return raw.select(F.col("subject_id").cast("string"), F.col("trial").cast("string"), *(F.col(c).try_cast("double").alias(c) for c in ("SBP", "DBP", "age")))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSVs of a folder, whatever their columns, with the subject told by the file's name."""
    raw = spark.read.option("header", True).csv(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    numbers = [F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns if c not in ("subject", "subject_id", "method", "roi")]
    return raw.select(F.regexp_extract(stem, r"^([^-]+)", 1).alias("subject_id"), F.regexp_extract(stem, r"-(.*)$", 1).alias("trial"), *numbers)


def find_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), any_of: tuple[str, ...] = (), none_of: tuple[str, ...] = ()) -> DataFrame:
    """Paths below a folder by extension and by words that their names hold or don't, whatever the case."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path"), F.lower(F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"))
    for words, keep in ((tuple(f".{e.lstrip('.').lower()}" for e in extensions), lambda w: F.col("name").endswith(w)), (tuple(w.lower() for w in any_of), lambda w: F.col("name").contains(w))):
        if words:
            names = names.where(sum((keep(w).cast("int") for w in words), F.lit(0)) > 0)
    for w in none_of:
        names = names.where(~F.col("name").contains(w.lower()))
    return names.select("path")


def write_signal(df: DataFrame, path: str, by: tuple[str, ...] = ("method", "roi"), form: str = "parquet") -> None:
    """One folder for each value of the partition columns, so readers of few of them skip the rest."""
    df.write.partitionBy(*by).format(form).option("header", True).mode("overwrite").save(path)


def find_folders(spark: SparkSession, path: str, any_of: tuple[str, ...] = (), none_of: tuple[str, ...] = ()) -> DataFrame:
    """Folders below a path that hold files at any depth, by words that their own names hold or don't, whatever the case."""
    root = F.length(F.regexp_extract(F.lit(path), r"^(?:file:)?(.*?)/*$", 1))
    below = find_files(spark, path).select(F.regexp_replace("path", "^file:/*", "/").alias("path")).select(F.split(F.substring(F.col("path"), root + 2, F.length("path")), "/").alias("parts"))
    each = below.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("folder")).where(F.col("folder") != "").distinct()
    name = F.lower(F.regexp_extract("folder", r"([^/]+)$", 1))
    if any_of:
        each = each.where(sum((name.contains(w.lower()).cast("int") for w in any_of), F.lit(0)) > 0)
    for w in none_of:
        each = each.where(~name.contains(w.lower()))
    return each


def write_predictions(x: DataFrame, path: str, by: str, time: str | None = "time_sec", order: str = "t") -> None:
    """True and predicted values with seven decimals as CSV, one folder for each value of `by`; without a time its place from 0.

    Rows of one series are written together and in order.
    """
    w = Window.partitionBy(by).orderBy(order)
    axis = F.format_string("%.7f", F.col(time).cast("double")).alias("time_sec") if time else F.format_string("%.7f", (F.row_number().over(w) - 1).cast("double")).alias("index")
    rows = x.select(by, order, axis, *(F.format_string("%.7f", F.col(c).cast("double")).alias(c) for c in ("y_true", "y_pred")))
    rows.repartition(by).sortWithinPartitions(by, order).drop(order).write.partitionBy(by).option("header", True).mode("overwrite").csv(path)


def new_manifests(template: DataFrame, subjects: DataFrame, roi: str, base: str = "deep-learning-dataset") -> DataFrame:
    """A manifest for each subject (column subject_id) from one template (read_manifests): paths of its own in the folders of its region.

    The template's path up to the folder `base`, else its parent, is kept; the reference signal has no region of its own.
    """
    upto = F.regexp_extract("path", rf"^(.*/{base})(?:/|$)", 1)
    kept = F.when(upto != "", upto).otherwise(F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    paths = template.select("fs_rppg", "fs_ppg_src", "bp", "detrend", F.explode("paths").alias("method", "path")).withColumn("kept", kept)
    folder = F.concat(F.upper("method"), F.when(F.lower("method") == "ppg", F.lit("_before")).otherwise(F.lit(f"_{roi}")))
    own = subjects.select("subject_id").join(F.broadcast(paths)).withColumn("path", F.concat_ws("/", "kept", folder, F.concat("subject_id", F.lit(".csv"))))  # a few paths of one manifest
    grouped = own.groupBy("subject_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "path")))).alias("paths"), *(F.first(c).alias(c) for c in ("fs_rppg", "fs_ppg_src", "bp", "detrend")))
    return grouped.select("subject_id", F.lit(roi).alias("roi_name"), "paths", F.struct("fs_rppg", "fs_ppg_src", "bp", "detrend").alias("meta"))


def write_manifests(manifests: DataFrame, path: str) -> None:
    """JSON lines, a folder for each region."""
    manifests.write.partitionBy("roi_name").mode("overwrite").json(path)


def log_rows(spark: SparkSession, path: str, rows: list[dict], schema: str) -> None:
    """Append rows of a run (epochs, folds, errors) to a log table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").option("header", True).csv(path)
