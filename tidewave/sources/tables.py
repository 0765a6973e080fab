"""The driver's tables in the shapes that the operators take: colour traces, signals and pre-cut beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.operators.relational import rank_within


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of series that a task sorts at a time, on average.
ROWS = 250_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """By keys, into as many tasks as ROWS asks for, where these are more than the cores: what one sorts stays of a size as the table grows. Windows over the keys reuse the exchange."""
    parts = -(-rows.count() // ROWS)  # Parquet's footers tell it
    return rows.repartition(parts, *keys) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def colour_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, t (from 1, no gaps), r, g, b: a trace for each supplier. The key is renamed first, so later windows on k reuse its exchange."""
    rows = dealt(table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey")), "k")
    order = Window.partitionBy("k").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rows.select("k", F.row_number().over(order).cast("long").alias("t"), F.col("l_quantity").alias("r"), (F.col("l_extendedprice") / 1000).alias("g"), (1 + 100 * F.col("l_discount")).alias("b"))


def recording_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, k, t, r, g, b: the colour traces as regions of three recordings, of which one has its colours in 0 to 1.

    Rows are dealt by their series, not by the recording, of which there may be few.
    """
    rows = dealt(table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey")).withColumn("rec", F.col("k") % 3), "rec", "k")
    order = Window.partitionBy("rec", "k").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    scale = F.when(F.col("rec") == 1, 255.0).otherwise(1.0)
    colours = {"r": F.col("l_quantity"), "g": F.col("l_extendedprice") / 1000, "b": 1 + 100 * F.col("l_discount")}
    return rows.select("rec", "k", F.row_number().over(order).cast("long").alias("t"), *((v / scale).alias(c) for c, v in colours.items()))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, t (from 1), sec, channel, v: an irregular signal for each user."""
    rows = dealt(table(spark, sf_dir, "events").withColumn("k", F.col("user_id")), "k")
    order = Window.partitionBy("k").orderBy("ts", "event_id")
    return rows.select("k", F.row_number().over(order).cast("long").alias("t"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"), F.col("event_type").alias("channel"), F.col("value").alias("v"))


def cut_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, beat (from 1), pos (from 0), v: each embedding as a beat of its label's series, dealt by series and beat, as there are few labels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("k"), "vec_id", "embedding")
    ranked = rank_within(rows, "k", F.col("vec_id"), "place")
    numbered = ranked.select("k", (F.col("place") + 1).alias("beat"), "embedding").repartition("k", "beat")
    return numbered.select("k", "beat", F.posexplode("embedding").alias("pos", "v")).select("k", "beat", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))
