"""Near-duplicates by improved consistent weighted sampling over TF-IDF weighted word shingles.

A document is the weighted set of its five-word shingles (all its words, if fewer than five): weight = occurrences times
idf, where idf = 1 + ln(1 / max(share of documents with the shingle, COMMON)). Shingles rarer than COMMON weigh alike, so
only the common ones need counting: at most mean shingles per document / COMMON of them can exist, which bounds what is
collected and broadcast whatever the size of the input. What stands in every tenth document weighs less than half of what
is rare. (Counting every shingle's documents would take a shuffle of all shingles and another to bring the counts back.) They are found exactly in two passes: a shingle that common overall is at least half as common in
some task's share of the documents (or would not reach half of it in all), then candidates are counted over all documents.

Each document gets BANDS * ROWS samples (Ioffe's scheme: r and c from Gamma(2, 1), beta uniform, all from hashes of shingle
and sample number); documents whose samples agree throughout a band are candidates. In a band's bucket every text is
compared with the smallest document's, which takes as many comparisons as texts and joins most; then every two texts of
the bucket that are in different components are compared, in blocks of pairs, so that no candidate pair stays open. A pair
links if its weighted Jaccard similarity, computed from the full texts, is at least THRESHOLD; classes are the connected
components. Identical texts are one node from the start.

Texts of equal words are copies at similarity 1; of a near copy whose words differ in a share p, here and there, about
(1 - 5 p) / (1 + 5 p) stays: THRESHOLD links up to one changed word in 45.

Defined results: null text counts as empty; equal texts are one class, and so are all texts without words; of documents
that tie the smallest doc_id names the class; very long texts are read whole; a null doc_id joins its text's class but links no
further (its class is null if no other row has its text); rows with one doc_id are one document; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import clean_ids, marked, mix64, spread, table, text_pieces, utf8_view, word_view, written

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 3
BANDS = 10
COMMON = 0.002
#: A text with more than this share of the rows has its class broadcast: there are at most 1 / HOT such texts.
HOT = 1 / 1024
#: Texts that are compared with one other in one task's group; a larger bucket is split into salted parts.
GROUP = 256
_PIECE = 1 << 18
_UNIT = 2_000_000
#: Documents that a task counting shingles gets at least, if there are as many: of a few documents every shingle could be common.
PER_TASK = 4_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and occurrences of each distinct shingle of the texts, in order of row and hash."""
    data, offsets = utf8_view(part.column("text"))
    _, _, words, firsts = word_view(data, offsets)
    counts = np.diff(firsts)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    at = firsts[:-1][rows] + np.arange(len(rows)) - np.concatenate([[0], np.cumsum(n)[:-1]])[rows]
    hashes = np.full(len(at), SHINGLE, np.uint64)
    for k in range(SHINGLE):
        hashes += words[at + k] * _ODD[k]
    for row in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = words[firsts[row] : firsts[row + 1]]
        rows = np.append(rows, row)
        hashes = np.append(hashes, np.uint64(len(own)) + (own * np.asarray(_ODD[: len(own)])).sum(dtype=np.uint64))
    hashes = mix64(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


def common_shingles(docs: DataFrame, n: int, common: float = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hash (ascending) and number of documents of every shingle that at least common * n documents have."""

    def gather(batches):
        before, held, n_held, n_docs = ([], 0), [], 0, 0

        def flush(parts, documents):
            found, times = np.unique(np.concatenate(parts), return_counts=True)
            keep = times >= max(1.0, common / 2 * documents)
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], ["shingle", "n"])

        for part in text_pieces(batches, _PIECE):
            _, hashes, _ = shingles(part)
            held.append(hashes)
            n_held += len(hashes)
            n_docs += part.num_rows
            if n_held >= _UNIT:
                if before[0]:
                    yield flush(*before)
                before, held, n_held, n_docs = (held, n_docs), [], 0, 0
        if before[0] or n_held:  # what is left goes with the last unit: by itself it would be a few documents, of which every shingle would pass
            yield flush(before[0] + held, before[1] + n_docs)

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, n // PER_TASK)  # fewer only where the input lies in many small pieces
    likely = docs.coalesce(parts).mapInArrow(gather, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= common / 2 * n).select("shingle")
    found = np.sort(likely.toArrow()["shingle"].to_numpy().astype(np.int64).view(np.uint64))  # at most 2 / common times the mean number
    if not len(found):
        return found, np.zeros(0, np.int64)

    def count(batches):
        times = np.zeros(len(found), np.int64)
        for part in text_pieces(batches, _PIECE):
            _, hashes, _ = shingles(part)
            at = np.searchsorted(found, hashes)
            at[at == len(found)] = 0
            times += np.bincount(at[found[at] == hashes], minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(times)), pa.array(times[times > 0])], ["at", "n"])

    totals = np.zeros(len(found), np.int64)
    counted = docs.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    totals[counted["at"].to_numpy()] = counted["n"].to_numpy()
    keep = totals >= common * n
    return found[keep], totals[keep]


class Weights:
    """Logarithm of each shingle's idf."""

    def __init__(self, found: np.ndarray, totals: np.ndarray, n: int, common: float = COMMON):
        self.found, self.rest = found, np.float32(np.log(1 - np.log(common)))
        self.own = np.log(1 - np.log(np.maximum(totals / max(n, 1), common))).astype(np.float32)

    def __call__(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rest, np.float32)
        if len(self.found):
            at = np.searchsorted(self.found, hashes)
            at[at == len(self.found)] = 0
            hit = self.found[at] == hashes
            out[hit] = self.own[at[hit]]
        return out + np.log(times.astype(np.float32))


def samples(rows: np.ndarray, hashes: np.ndarray, log_weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n consistent weighted samples of each row that has shingles: those rows, and a code for each row and sample."""
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(rows)))
    out = np.empty((len(begin), n), np.uint64)
    low21, top = np.uint64((1 << 21) - 1), np.float32(2.0**-21)
    half = np.float32(0.5)
    for k in range(n):
        a = mix64(hashes + np.uint64((k * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)))
        b = mix64(a + _ODD[4])
        u = [(((x >> np.uint64(s)) & low21).astype(np.float32) + half) * top for x, s in ((a, 0), (a, 21), (a, 42), (b, 0), (b, 21))]
        r = -np.log(u[0] * u[1])
        t = np.floor(log_weights / r + u[2])
        height = np.log(-np.log(u[3] * u[4])) - r * (t - u[2] + 1)
        least = np.minimum.reduceat(height, begin) if len(begin) else height
        hit = np.flatnonzero(height == np.repeat(least, sizes))
        at = hit[np.searchsorted(hit, begin)]
        out[:, k] = mix64(hashes[at] + t[at].astype(np.int64).astype(np.uint64) * _ODD[1])
    return rows[begin], out


def sketches(docs: DataFrame, weights: Weights, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """The band keys of each text; all texts without words share theirs."""

    def run(batches):
        for part in text_pieces(batches, _PIECE):
            rows, hashes, times = shingles(part)
            own, codes = samples(rows, hashes, weights(hashes, times), bands * rows_per_band)
            keys = np.zeros((part.num_rows, bands), np.uint64)
            for k in range(bands):
                key = np.full(len(own), k + 1, np.uint64)
                for c in codes[:, k * rows_per_band : (k + 1) * rows_per_band].T:
                    key = mix64(key * _ODD[0] + c)
                keys[own, k] = key
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "t1", "t2")), values], ["doc_id", "t1", "t2", "bands"])

    return docs.mapInArrow(run, "doc_id long, t1 long, t2 long, bands array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets: hashes (ascending) and weights."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0]
    both = float(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def verified(docs: DataFrame, pairs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar. Only texts in pairs move: by doc_id, then to b's groups."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    members = pairs.join(sizes, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("center"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    centers = sizes.select(F.col("b").alias("doc_id"), F.col("b").alias("center"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    needed = marked(docs.select("doc_id", "text"), ids, "doc_id").where("marked").drop("marked")
    placed = needed.join(members.unionByName(centers), "doc_id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        center, own = None, []
        for part in text_pieces(batches, _PIECE):
            rows, hashes, times = shingles(part)
            worth = np.exp(weights(hashes, times).astype(np.float64))
            bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
            a, b = [], []
            for i, (doc_id, at, role) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "center", "role")), strict=True)):
                mine = (hashes[bounds[i] : bounds[i + 1]], worth[bounds[i] : bounds[i + 1]])
                if at != center:
                    center, own = at, []
                if not role:
                    own.append(mine)  # more than one only if rows repeat a doc_id
                elif any(similarity(mine, x) >= threshold for x in own):
                    a.append(doc_id)
                    b.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.repartition(n, "center", "part").sortWithinPartitions("center", "part", "role").mapInArrow(run, "a long, b long").distinct()


def open_members(shared: DataFrame, roots: DataFrame, group: int = GROUP) -> DataFrame:
    """Texts of buckets that are not one component yet, once for each block (i, j) of their bucket.

    A bucket's largest component is dealt into parts of about `group` texts, and so are its other texts; blocks are all
    pairs of parts with one of the others' in it. A bucket's center was compared with all and is left out.
    """
    rooted = shared.where("rep <> center").select("band", "key", "rep", "bands").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("band", "key").agg(F.max_by("root", F.struct("n", "root")).alias("bulk"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
    parts = sizes.select("band", "key", "bulk", F.ceil(F.col("most") / group).cast("int").alias("p"), F.ceil((F.col("n") - F.col("most")) / group).cast("int").alias("q"))
    dealt = rooted.join(parts, ["band", "key"]).withColumn("part", F.expr("cast(if(root = bulk, pmod(xxhash64(rep), p), p + pmod(xxhash64(rep), q)) as int)"))
    across = F.expr("transform(sequence(p, p + q - 1), x -> struct(least(part, x) as i, greatest(part, x) as j))")
    with_bulk = F.expr("if(root = bulk, array(), transform(sequence(0, p - 1), x -> struct(x as i, part as j)))")
    return dealt.select("band", "key", F.col("rep").alias("doc_id"), "root", "bands", "part", F.explode(F.concat(across, with_bulk)).alias("_b")).select("*", "_b.i", "_b.j").drop("_b")


def linked_in(block: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Links (larger, smaller doc_id) among a block's texts: (doc_id, root, part, bands, band, i, j, hashes, weights) each.

    Pairs of one component, or of one part unless the block is a part with itself, are not compared, nor are those that
    meet in an earlier band's bucket too.
    """
    block = [x for x in block if len(x[7])]
    if len(block) < 2:
        return []
    ids, _, part, bands, band, i, j = ([x[k] for x in block] for k in range(7))
    part, component = np.asarray(part), np.unique([x[1] for x in block], return_inverse=True)[1]
    before = np.asarray(bands, np.int64)[:, : band[0]]
    sizes = np.asarray([len(x[7]) for x in block])
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.unique(np.concatenate([x[7] for x in block]), return_inverse=True)[1]
    worth = np.concatenate([x[8] for x in block])
    total = np.add.reduceat(worth, first[:-1])
    dense = np.zeros(int(at.max()) + 1)
    out = []
    for x in range(len(block) - 1):
        rest = np.arange(x + 1, len(block))
        rest = rest[(component[rest] != component[x]) & ((part[rest] != part[x]) | (i[0] == j[0]))]
        rest = rest[~(before[rest] == before[x]).any(axis=1)]
        if not len(rest):
            continue
        own = slice(first[x], first[x + 1])
        dense[at[own]] = worth[own]
        low = first[rest[0]]
        both = np.add.reduceat(np.minimum(dense[at[low:]], worth[low:]), first[rest[0] : -1] - low)[rest - rest[0]]
        dense[at[own]] = 0
        for y in rest[both / (total[x] + total[rest] - both) >= threshold]:
            out.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
            component[component == component[y]] = component[x]
    return out


def verified_blocks(docs: DataFrame, members: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """The links (a, b) among the texts of each block of open_members() (written)."""
    needed = marked(docs.select("doc_id", "text"), members.select("doc_id").distinct(), "doc_id").where("marked").drop("marked")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("band", "key", "i", "j")

    def run(batches):
        now, block = None, []

        def flush():
            found = linked_in(block, threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for piece in text_pieces(batches, _PIECE):
            rows, hashes, times = shingles(piece)
            worth = np.exp(weights(hashes, times).astype(np.float64))
            bounds = np.searchsorted(rows, np.arange(piece.num_rows + 1))
            held = {c: piece.column(c).to_pylist() for c in (*names, "doc_id", "root", "part", "bands")}
            for k, name in enumerate(zip(*(held[c] for c in names), strict=True)):
                if name != now:
                    if block:
                        yield flush()
                    now, block = name, []
                mine = slice(bounds[k], bounds[k + 1])
                block.append((held["doc_id"][k], held["root"][k], held["part"][k], held["bands"][k], name[0], name[2], name[3], hashes[mine].copy(), worth[mine].copy()))
        if block:
            yield flush()

    return needed.join(members, "doc_id").repartition(n, *names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's connected component (large-star and small-star steps until nothing changes)."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows_per_band: int = ROWS, common: float = COMMON, group: int = GROUP) -> DataFrame:
    """Per document: its class (smallest doc_id in it), and the smallest doc_id with the same text."""
    keyed = spread(clean_ids(docs, "doc_id", "text")).withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    n = docs.count()
    weights = Weights(*common_shingles(keyed, n, common), n, common)
    sketched = written(sketches(keyed, weights, bands, rows_per_band), "sketches")
    texts = written(sketched.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "texts")
    buckets = texts.where("rep is not null").select("rep", "bands", F.posexplode("bands").alias("band", "key"))
    sizes = buckets.groupBy("band", "key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(buckets.join(sizes, ["band", "key"]), "buckets")
    stars = written(shared.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct(), "stars")
    links = written(verified(keyed, stars, weights, threshold), "links")
    roots = components(links)
    members = written(open_members(shared, roots, group), "members")
    more = written(verified_blocks(keyed, members, weights, threshold), "links")
    roots = components(links.unionByName(more))
    classed = written(texts.select("t1", "t2", "rep", "copies").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("t1", "t2", "copies", F.col("rep").alias("copy_of"), F.coalesce("root", "rep").alias("class_id")), "classed")
    hot = F.col("copies") > HOT * n
    known = F.broadcast(classed.where(hot).select("t1", "t2", F.struct("class_id", "copy_of").alias("of")))
    rows = sketched.select("doc_id", "t1", "t2").join(known, ["t1", "t2"], "left")
    found = rows.where("of is not null").select("doc_id", "of.class_id", "of.copy_of")
    rest = rows.where("of is null").join(classed.where(~hot), ["t1", "t2"]).select("doc_id", "class_id", "copy_of")
    return found.unionByName(rest)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each class: the smallest doc_id's (of repeated rows, one). Texts without words are one class."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), row.alias("_row"))
    classes = near_duplicates(docs)
    stays = classes.where("doc_id = class_id").select("doc_id").distinct()
    first = held.where("doc_id is not null").join(stays, "doc_id", "left_semi")
    first = first.groupBy("doc_id").agg(F.min_by("_row", "_th").alias("_row")) if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() else first
    known = held.where("doc_id is not null").select("_th").distinct()
    nameless = held.where("doc_id is null").join(known, "_th", "left_anti").dropDuplicates(["_th"])
    return first.select("_row.*").unionByName(nameless.select("_row.*"))


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
