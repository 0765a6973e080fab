"""Vectors as short codes: one codebook for each of four parts, entries found by vantage-point trees.

The codebooks (ENTRIES entries for each part, whatever the input) are all that the driver and the tasks share. A round
assigns every part of every vector to its codebook's nearest entry and sums up the parts of each entry in the tasks, so
that a task sends as many rows as there are entries, not vectors. Nearest entries come from a tree of vantage points: an
entry, and the others in two halves by their distance from it. A query visits the half nearer to its own distance first
and the other one only where the triangle inequality allows an entry no farther than the best: distances are rounded so
that no such half is missed, equal ones are visited (a tie goes to the lower index), and what decides are whole numbers.

Defined results: rows whose vector is null or has null or non-finite components are dropped; the longest vector's length,
filled up to a multiple of four, is that of all, shorter ones count as ending in zeros; of repeated vec_ids the smaller
vectors come first into the codebook, and rows without a vec_id never do, but they are coded; all rows are coded, repeated
ones alike; null labels are one label; an empty table gives no rows; extra columns are ignored. A component beyond
+-16,384 (LARGEST after scaling) raises an error, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import clean_ids, spread, table, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 24
#: Labels whose sums are broadcast to the rows; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
_LEAF = 16


def finite_vectors(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and `embedding` of the rows whose vector is there and all finite."""
    whole = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return clean_ids(df, *columns, "embedding").where(whole)


def integers(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) for the components x of each vector, short vectors filled with zeros."""
    whole = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where all sums stay below 2**53, else in longs."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if most * most * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * inner_products(a, b)


def _below(x):
    return np.nextafter(x, -np.inf)


def _above(x):
    return np.nextafter(x, np.inf)


class VantageTree:
    """Exact nearest entries: `nearest` gives each query's entry of least squared distance, the lowest index on ties."""

    def __init__(self, entries: np.ndarray, leaf: int = _LEAF) -> None:
        self.entries = entries
        self.visited = 0  # distances computed, for tests
        apart = np.sqrt(squared_distances(entries, entries).astype(np.float64))
        self.root = self._built(np.arange(len(entries)), apart, max(leaf, 2))

    def _built(self, members: np.ndarray, apart: np.ndarray, leaf: int):
        if len(members) <= leaf:
            return members
        inside = apart[np.ix_(members, members)]
        k = int(np.argmax(inside.var(1)))  # from there the others are told apart best
        point, others = members[k], np.delete(members, k)
        far = np.delete(inside[k], k)
        order = np.argsort(far, kind="stable")
        half = len(order) // 2
        shells = [(np.sort(others[x]), _below(far[x].min()), _above(far[x].max())) for x in (order[:half], order[half:])]
        return int(point), [(self._built(some, apart, leaf), low, high) for some, low, high in shells]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries))
        waiting = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while waiting:
            node, who, least = waiting.pop()
            who = who[least <= _above(np.sqrt(best[who].astype(np.float64)))]
            if not len(who):
                continue
            members = node if isinstance(node, np.ndarray) else np.array([node[0]])
            found = squared_distances(queries[who], self.entries[members])
            self.visited += found.size
            k = found.argmin(1)
            found, at = found[np.arange(len(who)), k], members[k]
            better = (found < best[who]) | ((found == best[who]) & (at < index[who]))
            best[who[better]], index[who[better]] = found[better], at[better]
            if isinstance(node, np.ndarray):
                continue
            away = np.sqrt(found.astype(np.float64))
            bounds = [np.maximum(_below(low - _above(away)), _below(_below(away) - high)) for _, low, high in node[1]]
            first = bounds[1] < bounds[0]
            for side, own in ((0, first), (1, ~first)):  # the side that these visit later goes below on the stack
                waiting.append((node[1][side][0], who[own], bounds[side][own]))
            for side, own in ((1, first), (0, ~first)):
                waiting.append((node[1][side][0], who[own], bounds[side][own]))
        return index, best


def _assigned(vectors: np.ndarray, trees: list[VantageTree]) -> tuple[np.ndarray, np.ndarray]:
    found = [tree.nearest(part) for tree, part in zip(trees, np.split(vectors, len(trees), axis=1), strict=True)]
    return np.stack([x[0] for x in found], 1), np.stack([x[1] for x in found], 1)


def _sums(vectors: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """Sums of the parts that each entry gets: part, entry, place (-1: their number), total."""
    parts, entries, size = books.shape

    def run(batches):
        trees = [VantageTree(x) for x in books]
        totals = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            whole = integers(batch.column("embedding"), parts * size, scale)
            index, _ = _assigned(whole, trees)
            for p in range(parts):
                order = np.argsort(index[:, p], kind="stable")
                used, first = np.unique(index[order, p], return_index=True)
                if len(used):
                    totals[p, used, 1:] += np.add.reduceat(whole[order, p * size : (p + 1) * size], first, axis=0)
                    totals[p, used, 0] += np.diff(np.append(first, len(order)))
        p, e, place = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array((place - 1).astype(np.int32)), pa.array(totals[p, e, place])], ["part", "entry", "place", "total"])

    rows = vectors.select("embedding").mapInArrow(run, "part int, entry int, place int, total long")
    return rows.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def trained_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks (part, entry, component) after the rounds; None if there is no vector with a vec_id."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0]
    first = vectors.where("vec_id is not null").orderBy("vec_id", "embedding").limit(entries).select("embedding").collect()
    if not first:
        return None
    size = max(1, -(-longest // parts))
    start = integers(pa.array([list(r[0]) for r in first], pa.list_(pa.float64())), parts * size, scale)
    books = np.stack(np.split(start, parts, axis=1))
    for _ in range(rounds):
        totals = np.zeros((parts, len(first), size + 1), np.int64)
        for r in _sums(vectors, books, scale).collect():  # at most one row a component of the codebooks
            totals[r["part"], r["entry"], r["place"] + 1] = r["total"]
        used = totals[:, :, 0] > 0
        moved = books.copy()
        moved[used] = totals[used][:, 1:] // totals[used][:, :1]
        if (moved == books).all():
            break  # further rounds change nothing
        books = moved
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    parts, _, size = books.shape
    digits = np.array([f"{k:02x}" for k in range(ENTRIES)], "S2")

    def run(batches):
        trees = [VantageTree(x) for x in books]
        for batch in batches:
            index, error = _assigned(integers(batch.column("embedding"), parts * size, scale), trees)
            code = np.ascontiguousarray(digits[index]).view(f"S{2 * parts}")[:, 0].astype(f"U{2 * parts}")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, "vec_id long, label long, code string, error long")


def compressed(df: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows of df (vec_id, embedding, label)."""
    vectors = spread(finite_vectors(df, "vec_id", "label"))
    books = trained_codebooks(vectors)
    if books is None:  # no rows with a vec_id, hence no codebook
        return vectors.limit(0).selectExpr("cast(vec_id as long) as vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    rows = written(coded(vectors, books), "codes")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if sums.count() <= broadcast_labels:
        sums = F.broadcast(sums)
    told = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_part_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    return f"""
a{k} as (select x.vec_id, x.p, min({{'d': x.n - 2 * list_inner_product(x.s, c.s) + list_inner_product(c.s, c.s), 'e': c.e}}) as best
         from parts x join c{k} c using (p) group by all),
c{k + 1} as (select p, e, list(coalesce((total - ((total % n) + n) % n) / n, old) order by i) as s from (
         select c.p, c.e, i, c.s[i] as old, total, n from (select p, e, s, unnest(range(1, len(s) + 1)) as i from c{k}) c left join (
         select p, best.e as e, i, sum(s[i]) as total, count(*) as n from (select a.p, a.best, x.s, unnest(range(1, len(x.s) + 1)) as i from a{k} a join parts x using (vec_id, p)) group by all) using (p, e, i))
         group by p, e),"""


#: The same rounds by all distances; sums of whole numbers in doubles are exact at these sizes.
SQL = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
         where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as (select vec_id, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) as s from kept, range(4) t(p)),
parts as (select vec_id, p, s, list_inner_product(s, s) as n from cut),
c0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, s from parts qualify e < 256),
{''.join(_round_sql(k) for k in range(ROUNDS))}
a4 as (select x.vec_id, x.p, min({{'d': x.n - 2 * list_inner_product(x.s, c.s) + list_inner_product(c.s, c.s), 'e': c.e}}) as best from parts x join c4 c using (p) group by all),
told as (select vec_id, string_agg(format('{{:02x}}', best.e), '' order by p) as code, cast(sum(best.d) as bigint) as error from a4 group by vec_id),
digest as (select sha256(string_agg(cast(cast(s[i] as bigint) as varchar), ',' order by p, e, i)) as d from (select p, e, s, unnest(range(1, len(s) + 1)) as i from c4))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, d as codebooks_sha256 from told join kept using (vec_id), digest
"""
