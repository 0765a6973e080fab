"""Where recordings lie: file layouts of a study as relations of source and target, what is missing, and copies made by the tasks.

A layout is a table (source, target); nothing is touched until `copy_files` is asked to.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators.relational import condition, subject_id

#: Methods whose waves are laid out, and the suffixes of their files by preference (the later one wins).
METHODS = ("LGI", "POS", "OMIT", "ICA", "CHROM")
SUFFIXES = (".csv", ".CSV", ".txt", ".TXT")


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def by_method_and_region(paths: DataFrame) -> DataFrame:
    """METHOD/{subject}_{condition}_{region}.csv to METHOD_{region}_{condition}/{subject}.csv: source, target; target is null where the name says too little."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)\.csv$", 1))
    method = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    part = lambda i: F.regexp_extract(name, r"^(\d+)[_\-]?([a-z]+)[_\-]?([a-z]+)", i)
    target = F.concat(method, F.lit("_"), part(3), F.lit("_"), part(2), F.lit("/"), part(1), F.lit(".csv"))
    return paths.select(F.col("path").alias("source"), F.when((part(1) != "") & (method != ""), target).alias("target"))


def by_method(paths: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """subject/video/images-*_{condition}/rPPG-pulse/METHOD/REGION/bandpass_pulse.csv (or .txt) to METHOD/{subject}_{condition}_{region}.csv, and
    the first file of a subject whose name holds "ppg" to PPG/{subject}_{condition}.csv: source, target. Other files are left out.
    """
    parts = _parts(F.col("path"))
    at = lambda i: F.try_element_at(parts, F.lit(i))
    region = F.lower(F.regexp_replace(at(-2), "[^0-9a-zA-Z]+", ""))
    numbered = F.regexp_extract(at(-2), r"(?i)roi[_\-]?(\d+)", 1)
    region = F.when(numbered != "", F.concat(F.lit("roi"), F.lpad(numbered, 2, "0"))).otherwise(F.substring(region, 1, 8))
    is_wave = (at(-4) == "rPPG-pulse") & at(-3).isin(*methods) & at(-1).rlike(r"^bandpass_pulse.*\.(csv|txt)$") & at(-5).startswith("images-")
    subject = subject_id(at(-7))
    waves = paths.where(is_wave).select(F.col("path").alias("source"), F.concat_ws("", at(-3), F.lit("/"), subject, F.lit("_"), condition(at(-5)), F.lit("_"), region, F.lit(".csv")).alias("target"))
    signals = paths.where(F.lower(at(-1)).contains("ppg") & F.lower(at(-1)).endswith(".csv") & ~F.col("path").contains("/rPPG-pulse/"))
    own = signals.select("path", subject_id(at(1)).alias("subject"), condition(at(-1)).alias("condition")).where("subject is not null")
    first = own.groupBy("subject").agg(F.min(F.struct("path", "condition")).alias("f"))
    return waves.unionByName(first.select(F.col("f.path").alias("source"), F.concat(F.lit("PPG/"), F.col("subject"), F.lit("_"), F.col("f.condition"), F.lit(".csv")).alias("target")))


def expected(subjects: DataFrame, methods: list[str], regions: list[str], when: str = "before") -> DataFrame:
    """subject, method, region, path: where each subject's waves of one condition are by the study's scheme. Methods and regions are a few names."""
    names = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(r).alias("region")) for m in methods for r in regions]))
    each = subjects.select("subject", names.alias("n")).select("subject", "n.*")
    path = F.format_string(f"%s/video/images-%s_FullHDwebcam_{when}/rPPG-pulse/%s/%s/bandpass_pulse.csv", "subject", "subject", "method", "region")
    return each.withColumn("path", path)


def by_subject(found: DataFrame, wanted: DataFrame, when: str = "before") -> DataFrame:
    """expected() files that are there (found: path) and where they go: source, target METHOD_REGION_{when}/{subject}.csv."""
    there = wanted.join(found.select("path"), "path", "left_semi")
    return there.select(F.col("path").alias("source"), F.concat("method", F.lit("_"), "region", F.lit(f"_{when}/"), "subject", F.lit(".csv")).alias("target"))


def missing(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """expected() files that are not there."""
    return wanted.join(found.select("path"), "path", "left_anti")


def index_by_subject(paths: DataFrame) -> DataFrame:
    """sid, path: one file for each subject's number in the file's name; of several the one of the latest suffix of SUFFIXES, then the last path. Files without a number or such a suffix are left out."""
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    order = F.array_position(F.array(*map(F.lit, SUFFIXES)), suffix)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    rows = paths.select(subject_id(stem).cast("long").alias("sid"), "path", order.alias("o")).where("sid is not null and o > 0")
    return rows.groupBy("sid").agg(F.max_by("path", F.struct("o", "path")).alias("path"))


def clashes(moves: DataFrame) -> DataFrame:
    """target, n of targets that more than one source would be written to."""
    return moves.where("target is not null").groupBy("target").agg(F.count("*").alias("n")).where("n > 1")


def copy_files(spark: SparkSession, moves: DataFrame, source: str, target: str) -> DataFrame:
    """Copy the files of moves (paths below `source` and `target`), each by the task that reads it: source, target, bytes.

    Spark reads the files; tasks write whole files to the target's file system, so a task that runs twice leaves the same
    file. Rows without a target are left out. Nothing is deleted.
    """
    root = source.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", f"{_quoted(root)}/(.*)$", 1).alias("source"), "content")
    rows = files.join(moves.where("target is not null").select("source", "target"), "source")
    top = target.rstrip("/")

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(top if "://" in top else f"file://{top}")
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("target").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = f"{base}/{name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("target"), pa.array(sizes, pa.int64())], ["source", "target", "bytes"])

    return rows.select("source", "target", "content").mapInArrow(run, "source string, target string, bytes long")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def three_stages(x: DataFrame, rate: float | None = 30.0) -> DataFrame:
    """stem, stage (rppg_input, ppg_true, ppg_pred), time_sec, pulse for rows (stem, t from 1, time_sec, given, true, predicted), of which rows that lack a given or true value are left out.

    A series without times has them from its rate, without a rate its places from 0. Write it with files.write_signal, by stem and stage.
    """
    place = (F.col("t") - 1) / rate if rate else (F.col("t") - 1).cast("double")
    whole = x.where("given is not null and `true` is not null").withColumn("time_sec", F.coalesce("time_sec", place))
    stages = F.explode(F.array(*[F.struct(F.lit(stage).alias("stage"), F.col(c).cast("double").alias("pulse")) for stage, c in (("rppg_input", "given"), ("ppg_true", "`true`"), ("ppg_pred", "predicted"))]))
    return whole.select("stem", "t", "time_sec", stages.alias("s")).select("stem", "s.stage", "t", "time_sec", "s.pulse")
