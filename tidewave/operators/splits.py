"""Folds and splits that are the same however the rows are partitioned: by ranks and portable hashes, never by chance.

Ranks over all subjects are one sort of a distinct list of subjects, not of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators.relational import global_rank


def _ranked(x: DataFrame, subject: str, hashed: bool) -> DataFrame:
    """Each subject's place (from 0) and the number of subjects."""
    subjects = x.select(subject).where(F.col(subject).isNotNull()).distinct()
    key = F.md5(F.col(subject).cast("string")) if hashed else F.col(subject)
    total = subjects.agg(F.count(F.lit(1)).alias("n"))
    return global_rank(subjects, key, "place").join(F.broadcast(total))  # one row


def loso(x: DataFrame, subject: str) -> DataFrame:
    """A fold for each subject."""
    return x.join(_ranked(x, subject, False).select(subject, F.col("place").cast("long").alias("fold")), subject)


def subject_folds(x: DataFrame, subject: str, k: int) -> DataFrame:
    return x.join(_ranked(x, subject, True).select(subject, (F.col("place") % k).cast("long").alias("fold")), subject)


def row_folds(x: DataFrame, row_id: str, k: int) -> DataFrame:
    """By the first hexadecimal digits of the row's hash: no sort of all rows."""
    return x.withColumn("fold", F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("long") % k)


def leave_trial_out(x: DataFrame, subject: str, trial: str) -> DataFrame:
    """subject, trial (the test side), n_test, n_train; only where the subject has other trials."""
    per = x.groupBy(subject, trial).agg(F.count(F.lit(1)).alias("n_test"))
    return per.withColumn("n_train", F.sum("n_test").over(Window.partitionBy(subject)) - F.col("n_test")).where("n_train > 0")


def three_way(x: DataFrame, subject: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Subjects to train, val and test by their hashed rank; the rest is test, each has one at least."""
    ranked = _ranked(x, subject, True)
    a = F.greatest(F.floor(F.col("n") * train + 0.5), F.lit(1))
    b = a + F.greatest(F.floor(F.col("n") * val + 0.5), F.lit(1))
    return x.join(ranked.select(subject, F.when(F.col("place") < a, "train").when(F.col("place") < b, "val").otherwise("test").alias("part")), subject)


def _row_ranks(x: DataFrame, row_id: str) -> DataFrame:
    """The rows in the order of their ids' hashes: place (from 0) and n."""
    return global_rank(x, F.md5(F.col(row_id).cast("string")), "place").join(F.broadcast(x.agg(F.count(F.lit(1)).alias("n"))))


def equal_folds(x: DataFrame, row_id: str, k: int) -> DataFrame:
    """k folds of equal size; the first ones have a row more where the rows don't divide."""
    size, more = F.floor(F.col("n") / k), F.col("n") % k
    long = (size + 1) * more
    fold = F.when(F.col("place") < long, F.floor(F.col("place") / (size + 1))).otherwise(more + F.floor((F.col("place") - long) / F.greatest(size, F.lit(1))))
    return _row_ranks(x, row_id).withColumn("fold", fold.cast("long")).drop("place", "n")


def train_val(x: DataFrame, row_id: str, share: float) -> DataFrame:
    """The first floor(n * share) rows by hash are val, the others train."""
    return _row_ranks(x, row_id).withColumn("part", F.when(F.col("place") < F.floor(F.col("n") * share), "val").otherwise("train")).drop("place", "n")


def random_three_way(x: DataFrame, row_id: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Rows by hash: floor(n * train) to train, floor(n * val) to val, the rest to test."""
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    return _row_ranks(x, row_id).withColumn("part", F.when(F.col("place") < a, "train").when(F.col("place") < a + b, "val").otherwise("test")).drop("place", "n")
