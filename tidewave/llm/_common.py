"""Shared helpers of the corpus operators: input, scratch tables, Arrow text views."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at a time; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch on its way to Python, where the session holds Spark's default: 10,000 long texts would be 34 MB and more, in the JVM and in Python.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows over all cores when the input comes in fewer splits than there are cores; bound the session's Arrow batches, unless it has a bound of its own."""
    spark = df.sparkSession
    if spark.conf.get(_BATCHES, "64m") in ("64m", f"{64 << 20}b", str(64 << 20)):  # Spark's own
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", top)
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    return top


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the filter that `marked` broadcasts, 64 to a row: at most 2**18 rows, 4 MB.
FILTER_BITS = 1 << 24


def marked(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """df with a column `marked` more: true wherever keys (a written table) holds the row's columns, and for a few others.

    It keeps texts that no join needs out of the shuffle. The broadcast's size is fixed; with more keys than it has bits
    it marks more rows than needed, never fewer. Rows with null columns are not marked.
    """
    place = f"pmod(xxhash64({', '.join(columns)}), {FILTER_BITS}L)"
    some = " and ".join(f"{c} is not null" for c in columns)
    bits = keys.where(some).select(F.expr(f"cast({place} div 64 as int)").alias("_w"), F.expr(f"shiftleft(1L, cast({place} % 64 as int))").alias("_b"))
    bits = bits.groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    found = df.withColumn("_w", F.expr(f"case when {some} then cast({place} div 64 as int) end")).join(F.broadcast(bits), "_w", "left")
    return found.withColumn("marked", F.expr(f"coalesce((_b & shiftleft(1L, cast({place} % 64 as int))) <> 0, false)")).drop("_w", "_b")


def text_pieces(batches, limit: int = PIECE_BYTES):
    """Cut record batches with a column `text` into slices of about `limit` bytes of text; null text becomes empty."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        columns = list(batch.columns)
        columns[at] = pc.fill_null(columns[at].cast(pa.large_string()), "")
        batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        sizes = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8_view(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and the offsets of its rows in them, without copying."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_RNG = np.random.RandomState(20250101)
_BYTE_CODE = _RNG.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """_BASE**0 .. _BASE**(n-1) modulo 2**64."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 2**64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


def word_view(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all rows: start byte, end byte, 64-bit hash, and each row's first word (rows + 1 numbers). Words are also cut before the bytes `cuts`, which lie inside of some."""
    inside = ~_SPACE[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[firsts] = inside[firsts]
    if cuts is not None:
        edge[cuts] = True
    starts = np.flatnonzero(edge)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[firsts[firsts > 0] - 1] = inside[firsts[firsts > 0] - 1]
    if cuts is not None:
        last[cuts - 1] = True
    ends = np.flatnonzero(last) + 1
    lengths = ends - starts
    flat = np.flatnonzero(inside)
    within = flat - np.repeat(starts, lengths)
    codes = _BYTE_CODE[data[flat]] * powers(int(lengths.max()))[within]
    bounds = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    hashes = mix64(np.add.reduceat(codes, bounds) + lengths.astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def clean_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so extra columns, whatever their names, never meet ours."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
