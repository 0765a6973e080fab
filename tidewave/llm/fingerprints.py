"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for two bases modulo the prime 2**31 - 1, the hash of every prefix. Any span's hash is then a
difference times a power, so spans of any two texts compare in constant time and their longest common extension is found
by binary search. A fingerprint is the set of the smallest mixed hashes of all spans of SPAN code points (the whole text
if shorter); likeness is the share of common ones among the smallest of both, which estimates the spans' Jaccard similarity.

Defined results: null text counts as empty, with the empty fingerprint; two empty texts are alike (1.0), an empty and
another are not (0.0); a null doc_id sorts before all others; rows with equal doc_id follow each other by text; a single
row's next document is itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import clean_ids, mix64, spread, table, text_pieces

PRIME = (1 << 31) - 1
BASES = (1_203_874_013, 987_654_361)
SPAN = 8
KEPT = 64
_P = np.uint64(PRIME)
_S31 = np.uint64(31)
_tables: list[list[np.ndarray]] = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in BASES]


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**63."""
    x = (x & _P) + (x >> _S31)
    x = (x & _P) + (x >> _S31)
    return np.where(x >= _P, x - _P, x)


def _power_tables(n: int) -> list[list[np.ndarray]]:
    """For each base its powers, and its inverse's, from 0 to n at least."""
    for own, base in zip(_tables, BASES, strict=True):
        for k, b in enumerate((base, pow(base, -1, PRIME))):
            while len(own[k]) <= n:
                own[k] = np.concatenate([own[k], _mod(own[k] * np.uint64(pow(b, len(own[k]), PRIME)))])
    return _tables


class PrefixHash:
    """Prefix arrays of one text, given as its code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        wide = codes.astype(np.uint64) + np.uint64(1)
        self.prefix = []
        for powers, _ in _power_tables(self.n):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod(wide * powers[: self.n]), out=sums[1:])
            self.prefix.append(_mod(sums))

    def spans(self, starts, length: int):
        """62-bit hashes of the spans of `length` code points at `starts` (a number or an array)."""
        out = np.uint64(0)
        for p, (_, inverse) in zip(self.prefix, _power_tables(self.n), strict=True):
            out = (out << _S31) | _mod((p[starts + length] + _P - p[starts]) * inverse[starts])
        return out

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        if length > min(self.n - start, other.n - other_start):
            return False
        for p, q, (_, inverse) in zip(self.prefix, other.prefix, _power_tables(max(self.n, other.n)), strict=True):
            own, its = int(p[start + length]) - int(p[start]), int(q[other_start + length]) - int(q[other_start])
            if (own * int(inverse[start]) - its * int(inverse[other_start])) % PRIME:
                return False
        return True

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """How many code points from the two starts on are the same, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self) -> np.ndarray:
        """The smallest KEPT distinct 32-bit mixed hashes of all spans, ascending."""
        if not self.n:
            return np.zeros(0, np.uint32)
        length = min(SPAN, self.n)
        if self.n - length < 4 * KEPT:
            found = mix64(self.spans(np.arange(self.n - length + 1), length)) >> np.uint64(32)
            return np.unique(found)[:KEPT].astype(np.uint32)
        hashes = np.uint64(0)
        for p, (_, inverse) in zip(self.prefix, _power_tables(self.n), strict=True):
            hashes = (hashes << _S31) | _mod((p[length:] + _P - p[:-length]) * inverse[: self.n - length + 1])
        found = mix64(hashes) >> np.uint64(32)
        for share in (8, 2):  # few of the spans of a long text can be among the smallest
            small = found[found < np.uint64((1 << 32) * share * KEPT // self.n)] if self.n > 4 * share * KEPT else found
            small = np.unique(small)
            if len(small) >= KEPT:
                return small[:KEPT].astype(np.uint32)
        return np.unique(found)[:KEPT].astype(np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.unique(np.concatenate([a, b]))[:KEPT]
    return float(np.isin(both, a, assume_unique=True) @ np.isin(both, b, assume_unique=True).astype(np.int64)) / len(both)


_ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start long, same_start_next long"


def in_id_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt to buckets of consecutive doc_id and sorted there, each bucket's end followed by the next one's first row.

    Bounds are ids found by a quantile sketch over the ids alone (as many as buckets), so the first id of each is known.
    Columns: bucket, peek (1: the next bucket's first), key, doc_id, text.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    cuts = [k / buckets for k in range(1, buckets)]
    row = docs.select(key.alias("key")).agg(F.min("key").alias("low"), F.percentile_approx("key", cuts, max(10_000, 4 * buckets)).alias("cuts") if cuts else F.array().cast("array<bigint>").alias("cuts")).first()
    if row.low is None:
        return docs.select(F.lit(0).alias("bucket"), F.lit(0).alias("peek"), key.alias("key"), "doc_id", "text").limit(0)
    bounds = np.unique(np.asarray([row.low, *row.cuts], np.int64))
    last = len(bounds) - 1

    def deal(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            own = np.searchsorted(bounds, keys, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.zeros(len(keys), np.int32)), *(batch.column(c) for c in ("key", "doc_id", "text"))], ["bucket", "peek", "key", "doc_id", "text"])
            firsts = np.flatnonzero(keys == bounds[own])
            if len(firsts):
                to = np.where(own[firsts] > 0, own[firsts] - 1, last).astype(np.int32)
                taken = batch.take(pa.array(firsts))
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(firsts), np.int32)), *(taken.column(c) for c in ("key", "doc_id", "text"))], ["bucket", "peek", "key", "doc_id", "text"])

    dealt = docs.select(key.alias("key"), "doc_id", "text").mapInArrow(deal, "bucket int, peek int, key long, doc_id long, text string")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "peek", "key", "text")


def fingerprints(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see the module's docstring.

    The edited text is the text with its last half replaced by as many code points of the next document. same_start and
    same_start_next: how many code points the text and its edited text, and the text and the next one, begin with alike.
    """
    docs = spread(clean_ids(docs, "doc_id", "text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_id_order(docs, 3 * n)

    def described(text: str):
        hashes = PrefixHash(code_points(text))
        return text, hashes, hashes.fingerprint()

    def row(doc_id, own, other):
        text, hashes, found = own
        half = len(text) // 2
        edited_text = text[: len(text) - half] + other[0][:half]
        edited = described(edited_text)
        return (doc_id, len(text), hashlib.sha256(edited_text.encode("utf-8")).hexdigest(), found.astype(">u4").tobytes().hex(), edited[2].astype(">u4").tobytes().hex(), likeness(found, edited[2]), likeness(found, other[2]), hashes.extension(0, edited[1], 0), hashes.extension(0, other[1], 0)) + ((edited_text,) * keep)

    names = [x.split()[0] for x in _ROWS.split(", ")] + ["edited"] * keep
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), *[pa.string()] * keep]

    def run(batches):
        held = None  # the bucket, id and description of the row before
        closed = True
        for part in text_pieces(batches):
            rows = []
            for bucket, peek, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "peek", "doc_id", "text")), strict=True):
                if peek and closed:
                    continue  # rows with the same first id: the first of them stands next
                now = described(text)
                if held is not None:
                    rows.append(row(held[1], held[2], now))
                held, closed = (None, True) if peek else ((bucket, doc_id, now), False)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ordered.mapInArrow(run, _ROWS + ", edited string" * keep)


def op7_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
