"""Hard negatives by inner product, found with vantage-point trees over norm-augmented vectors.

Every vector x gets one component more, sqrt(M - |x|^2), M being the largest squared norm, and an anchor q gets a zero: then
|q - x|^2 = |q|^2 + M - 2 q.x, so that high scores are short distances and a window of scores is an annulus around the anchor.

Rows are dealt to cells by their nearest pivot (PIVOTS rows at most, those of smallest hash; any would do) and large cells
to blocks by a hash, so no block outgrows a task, whatever repeats. An anchor is sent only to the cells that its annulus
meets, going by the cell's least and largest distance from its pivot. In a task a block becomes a tree of vantage points;
the leaves an anchor's annulus meets are visited nearest first, until the next leaf lies beyond the last row wanted. Bounds
are rounded outwards and equal ones visited; scores are whole numbers. Each block sends its best few for each anchor and
window, and a ranking, limited before the shuffle, merges those.

Positives are searched twice: in one block of the anchor's own cell, which gives a least score, then in the other blocks
that can hold a higher or equal one.

Defined results: rows with a null vec_id, label or vector, or with null or non-finite components take no part; shorter
vectors count as ending in zeros; repeated rows count once; rows that share a vec_id and differ are rows of their own, but
none is another row to an anchor of that vec_id; an anchor without positives, or whose positive score is negative, gives no
rows; ties go to the smaller vec_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm._common import spread, table, written
from tidewave.llm.codes import finite_vectors, inner_products, integers

SCALE = 256
PIVOTS = 256
#: Components that a block holds at most (about, as rows are dealt by hash), and rows that it need not fall below.
BLOCK_VALUES = 1 << 23
BLOCK_ROWS = 4_096
POSITIVES = 5
NEGATIVES = 3
#: Hundredths of the positive score between which a negative's lies.
LOW, HIGH = 50, 95
_LEAF = 128
_STEP = 8
_NO_LOW, _NO_HIGH = -(2**62), 2**62
_SALTS = 1 << 24


class Space:
    """Distances of augmented vectors; `most` is the largest squared norm."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.slack = 1e-9 * (1 + float(np.sqrt(most)))  # far above what rounding adds to a distance

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of data rows a from data rows b."""
        x, y = (v * v for v in (a, b))
        x, y = x.sum(1), y.sum(1)
        beyond = np.sqrt(np.maximum(self.most - x, 0))[:, None] - np.sqrt(np.maximum(self.most - y, 0))
        return np.sqrt(x[:, None] + y - 2 * inner_products(a, b) + beyond * beyond)

    def from_scores(self, norm: int, scores) -> np.ndarray:
        """Distances of rows with those scores from an anchor of squared norm `norm`."""
        return np.sqrt(np.maximum(float(norm + self.most) - 2.0 * np.asarray(scores, np.float64), 0))


def bounds(away: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of rows whose distance from a point lies in [low, high], where the point is `away`."""
    return np.maximum(low - away, away - high) - slack, away + high + slack


def distinct_rows(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Where repeated rows stand first, in a list; an empty one if no vec_id comes twice."""
    if len(np.unique(ids)) == len(ids):
        return []
    return [np.sort(np.unique(np.column_stack([ids, labels, rows]), axis=0, return_index=True)[1])]


class BlockTree:
    """Vantage-point tree of a block: rows in order of leaves, and of each leaf its shells around the points above it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, space: Space, leaf: int = _LEAF) -> None:
        self.space, self.visited = space, 0
        if keep := distinct_rows(ids, labels, rows):
            ids, labels, rows = (x[keep[0]] for x in (ids, labels, rows))
        points, shells, members = [], [], []
        waiting = [(np.arange(len(ids)), [])]
        while waiting:
            some, path = waiting.pop()
            if len(some) <= leaf:
                members.append(some)
                shells.append(path)
                continue
            point = some[len(some) // 2]
            away = space.apart(rows[some], rows[point : point + 1])[:, 0]
            order = np.argsort(away, kind="stable")
            points.append(point)
            for part in (order[len(order) // 2 :], order[: len(order) // 2]):
                waiting.append((some[part], [*path, (len(points) - 1, away[part].min(), away[part].max())]))
        order = np.concatenate(members)
        self.points = rows[points] if points else rows[:1]
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.ends = np.cumsum([len(x) for x in members])
        depth = max(1, max(map(len, shells)))
        padded = [[*path, *[(0, -np.inf, np.inf)] * (depth - len(path))] for path in shells]
        self.node = np.array([[s[0] for s in path] for path in padded])
        self.low, self.high = (np.array([[s[k] for s in path] for path in padded]) for k in (1, 2))

    def search(self, anchor: np.ndarray, own_id: int, own_label: int, lows, highs, k: int, same: bool):
        """For each window [low, high] of scores the best k of the rows of the anchor's label, or of the others: (window, id, score)."""
        norm = int(anchor @ anchor)
        away = self.space.from_scores(norm, inner_products(anchor[None], self.points)[0])
        least, most = bounds(away[self.node], self.low, self.high, self.space.slack)
        least, most = least.max(1), most.min(1)
        inner = self.space.from_scores(norm, np.minimum(max(highs), norm + self.space.most)) - self.space.slack  # the annulus of all windows
        outer = self.space.from_scores(norm, np.asarray(lows)) + self.space.slack
        order = np.argsort(np.maximum(least, inner), kind="stable")
        order = order[(most[order] >= inner) & (least[order] <= outer.max())]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lows]
        reach = outer.copy()
        for at in range(0, len(order), _STEP):
            some = order[at : at + _STEP]
            if least[some[0]] > reach.max():
                break
            where = np.concatenate([np.arange(self.ends[x - 1] if x else 0, self.ends[x]) for x in some])
            self.visited += len(where)
            fits = (self.ids[where] != own_id) & ((self.labels[where] == own_label) == same)
            where = where[fits]
            scores = inner_products(anchor[None], self.rows[where])[0]
            ids = self.ids[where]
            for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
                inside = (scores >= low) & (scores <= high)
                if len(found[w][0]) == k:
                    inside &= scores >= found[w][1][-1]
                if not inside.any():
                    continue
                both = [np.concatenate(x) for x in zip(found[w], (ids[inside], scores[inside]), strict=True)]
                best = np.lexsort((both[0], -both[1]))[:k]
                found[w] = (both[0][best], both[1][best])
                if len(best) == k:
                    reach[w] = self.space.from_scores(norm, found[w][1][-1]) + self.space.slack
        return [(w, i, s) for w, (ids, scores) in enumerate(found) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]


class Cells:
    """Pivots, the blocks of each one's cell, and least and largest distances of the cell's rows from it."""

    def __init__(self, space: Space, pivots: np.ndarray) -> None:
        self.space, self.pivots, self.width = space, pivots, pivots.shape[1]

    def dealt(self, rows: DataFrame) -> DataFrame:
        """vec_id, label, v (whole numbers), cell and distance from its pivot."""
        space, pivots, width = self.space, self.pivots, self.width

        def run(batches):
            for batch in batches:
                whole = integers(batch.column("embedding"), width, SCALE)
                ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
                if keep := distinct_rows(ids, labels, whole):
                    ids, labels, whole = (x[keep[0]] for x in (ids, labels, whole))
                away = space.apart(whole, pivots)
                cell = away.argmin(1)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * width), pa.array(whole.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), v, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], ["vec_id", "label", "v", "cell", "away"])

        return rows.mapInArrow(run, "vec_id long, label long, v array<int>, cell int, away double")

    def measure(self, rows: DataFrame, block_rows: int) -> None:
        self.blocks, self.low, self.high = (np.zeros(len(self.pivots), t) for t in (np.int64, float, float))
        for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect():  # a row a pivot
            self.blocks[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = -(-r["n"] // block_rows), r["low"], r["high"]

    def block(self) -> F.Column:
        """The block of a dealt row: its cell's number and a hash below the cell's number of blocks."""
        numbers = F.element_at(F.array(*[F.lit(int(n)) for n in self.blocks]), F.col("cell") + 1)
        return F.col("cell").cast("long") * _SALTS + F.pmod(F.xxhash64("vec_id"), numbers)

    def routed(self, anchors: DataFrame, home: bool | None) -> DataFrame:
        """Rows (anchor_id, aid, label, v, lows, highs) once for each block that their windows can meet: only the first of
        the nearest cell (home True), all but that one (False), or all (None)."""
        space, pivots, low, high, blocks = self.space, self.pivots, self.low, self.high, self.blocks

        def run(batches):
            for batch in batches:
                v = batch.column("v").flatten().to_numpy().reshape(-1, pivots.shape[1]).astype(np.int64)
                scores = inner_products(v, pivots)
                row, block = [], []
                for k, (lows, highs) in enumerate(zip(batch.column("lows").to_pylist(), batch.column("highs").to_pylist(), strict=True)):
                    norm = int(v[k] @ v[k])
                    away = space.from_scores(norm, scores[k])
                    own = int(np.where(blocks > 0, away, np.inf).argmin()) * _SALTS
                    if home:
                        row.append(k)
                        block.append(own)
                        continue
                    least, most = bounds(away, low, high, space.slack)
                    inner, outer = (space.from_scores(norm, s) for s in (min(max(highs), norm + space.most), min(lows)))
                    for c in np.flatnonzero((blocks > 0) & (least <= outer + space.slack) & (most >= inner - space.slack)).tolist():
                        for b in range(c * _SALTS, c * _SALTS + int(blocks[c])):
                            if home is None or b != own:
                                row.append(k)
                                block.append(b)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(batch.column(c).take(take) for c in ("anchor_id", "aid", "label", "v", "lows", "highs"))], ["block", "anchor_id", "aid", "label", "v", "lows", "highs"])

        return anchors.select("anchor_id", "aid", "label", "v", "lows", "highs").mapInArrow(run, "block long, anchor_id long, aid long, label long, v array<int>, lows array<long>, highs array<long>")


def searched(rows: DataFrame, routed: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """Of each anchor and window the best k of each block: anchor_id, aid, window, found_id, score.

    A task reads a block's rows, makes their tree, and answers the block's anchors as they come.
    """

    def run(batches):
        now, held, tree = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            anchor = batch.column("aid").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (anchor[1:] != anchor[:-1])])
            for begin, end in zip(cuts, np.append(cuts[1:], len(blocks)), strict=True):
                part = batch.slice(begin, end - begin)
                if blocks[begin] != now:
                    now, held, tree = blocks[begin], [], None
                v = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1).astype(np.int64)
                ids, labels = (part.column(c).to_numpy() for c in ("anchor_id", "label"))
                if not anchor[begin]:
                    held.append((ids, labels, v))
                    continue
                if tree is None and held:
                    tree, held = BlockTree(*(np.concatenate(x) for x in zip(*held, strict=True)), space), []
                if tree is None:
                    continue
                out = []
                for j, (aid, lows, highs) in enumerate(zip(part.column("aid").to_pylist(), part.column("lows").to_pylist(), part.column("highs").to_pylist(), strict=True)):
                    out += [(int(ids[j]), aid, *x) for x in tree.search(v[j], int(ids[j]), int(labels[j]), lows, highs, k, same)]
                if out:
                    names = ["anchor_id", "aid", "window", "found_id", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c == "window" else pa.int64()) for c, x in zip(names, zip(*out, strict=True), strict=True)], names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.select("block", F.col("vec_id").alias("anchor_id"), "label", "v").unionByName(routed, allowMissingColumns=True)
    both = both.repartition(n, "block").sortWithinPartitions("block", F.col("aid").isNotNull())
    return both.mapInArrow(run, "anchor_id long, aid long, window int, found_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor and window, ranked from 1."""
    order = Window.partitionBy("anchor_id", "aid", "window").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, block_values: int = BLOCK_VALUES, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among df (vec_id, label, embedding)."""
    rows = spread(finite_vectors(df, "vec_id", "label").where("vec_id is not null and label is not null"))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.floor(x.cast("double") * SCALE).cast("double") * F.floor(x.cast("double") * SCALE).cast("double"))
    n, width, most = rows.agg(F.count("*"), F.max(F.size("embedding")), F.max(norm)).first()
    if not n:
        return rows.limit(0).selectExpr("vec_id as anchor_id", "vec_id as positive_id", "0 as rank", "vec_id as negative_id", "vec_id as positive_score", "vec_id as negative_score")
    width = max(1, width)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_block = max(1, min(block_values // width, max(block_rows, n // (2 * parts))))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(min(pivots, -(-n // per_block))).select("embedding").collect()
    space = Space(int(most))
    cells = Cells(space, integers(pa.array([list(r[0]) for r in chosen], pa.list_(pa.float64())), width, SCALE))
    dealt = written(cells.dealt(rows), "cells")
    cells.measure(dealt, per_block)
    dealt = dealt.withColumn("block", cells.block())

    asking = written(dealt.where(anchors).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("aid"), "label", "v").distinct(), "anchors")
    everywhere = {"lows": F.array(F.lit(_NO_LOW)), "highs": F.array(F.lit(_NO_HIGH))}
    near = written(searched(dealt, cells.routed(asking.withColumns(everywhere), True), space, positives, True), "near")
    least = near.groupBy("anchor_id", "aid").agg(F.when(F.count("*") == positives, F.min("score")).alias("least"))
    rest = asking.join(least, ["anchor_id", "aid"], "left").withColumns(everywhere | {"lows": F.array(F.coalesce("least", F.lit(_NO_LOW)))})
    far = searched(dealt, cells.routed(rest, False), space, positives, True)
    good = written(best(near.unionByName(far), positives).select("anchor_id", "aid", "rank", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = good.where("positive_score >= 0").groupBy("anchor_id", "aid").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("w"))  # at most `positives`
    windows = windows.withColumns({"lows": F.transform("w", lambda x: F.ceil(x["positive_score"] * LOW / F.lit(100))), "highs": F.transform("w", lambda x: F.floor(x["positive_score"] * HIGH / F.lit(100)))})
    found = best(searched(dealt, cells.routed(asking.join(windows, ["anchor_id", "aid"]), None), space, negatives, False), negatives)
    # scores fall with the rank, so those of 0 or more have the first ranks and window w is the positive of rank w + 1
    paired = found.join(good.withColumn("window", F.col("rank") - 1).drop("rank"), ["anchor_id", "aid", "window"])
    return paired.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_annulus_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


#: The same by all scores.
SQL = f"""
with kept as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
         where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from kept a join kept b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positive as (select anchor_id, other as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, other) <= {POSITIVES})
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other) as integer) as rank, other as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id) where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score qualify rank <= {NEGATIVES}
"""
