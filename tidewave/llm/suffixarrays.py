"""Repeated byte passages, found with logarithmic families of suffix arrays.

A family is a list of sorted arrays whose sizes fall geometrically. A new batch is sorted (its suffix array), merge-scanned
against each level for entries they share, and what no level holds becomes a level of its own; levels of about one size
are merged, so that n entries cost n log n moves and a family holds each entry once, however often it came.

Two passes use families. First, every window of WINDOW bytes is filed under its anchor, a string inside it that its bytes
alone choose, so that equal windows have equal anchors: the smallest (by hash) of its PREFIX-byte strings, and half of the
window's other bytes from the side where the window has more of them. PREFIX bytes alone recur by chance, ever more
often in more texts; anchors hardly do. Neighbouring windows mostly share an anchor and make a run. Tasks send runs, many
to one record a bucket of anchors: the hash of a run's bytes, the anchor's, and the document. A bucket's family keeps
of each run its smallest document; in all others the whole run is repeated, and that is told without its bytes. Only runs
whose anchor other runs in other documents have too, each from its smallest document, are sent with their bytes to the
task of their anchor, in order of doc_id: each batch's windows are sorted by their bytes, and one that a level or the batch
holds from a smaller document is repeated. Neighbouring repeated windows make a span.

An anchor with more than HOT such runs is not gathered: its windows go by hash, lists of them grouped before they are
dealt. Equal texts have one place; in all but the smallest doc_id's every window is repeated.

Defined results: null text is empty; a null doc_id is neither smaller nor larger than any, so its row stays whole; rows with
one doc_id are one document; repeated rows are cut alike; very long texts are read in pieces that overlap; an empty table
gives no rows; extra columns are ignored. Runs are equal if the 64-bit hashes of their bytes, their anchors' buckets and 32 more
bits of their anchors' hashes are; windows of unequal runs are compared by their bytes, those of hot anchors by two 64-bit
hashes (the anchor's and the window's).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import _BYTE_CODE, clean_ids, marked, mix64, powers, spread, table, text_pieces, utf8_view, written
from tidewave.llm.substrings import RUN, _inverse_powers, _places, _whole_windows, copied, sequences

WINDOW = 50
PREFIX = 16
#: Runs of one anchor whose windows a task may gather.
HOT = 4_000
#: Windows or runs of a batch, and runs that a task holds before it sends them.
BATCH = 500_000
HELD = 2_000_000
#: What is told of a run in a document: a smaller one has it too, or its windows are to be compared, by their bytes or by hash.
COVERED, BYTES, HASHES = range(3)
_PIECE = 1 << 18
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Family:
    """Levels of distinct sorted keys with columns of values; each level is at least twice as large as the next one."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    def find(self, keys: np.ndarray):
        """For each level that holds some of the sorted keys: the level, places in keys, places in the level."""
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], keys), len(level[0]) - 1)
            mine = np.flatnonzero(level[0][at] == keys)
            if len(mine):
                yield level, mine, at[mine]

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        """Take sorted keys that no level holds."""
        if not len(keys):
            return
        self.levels.append([keys, *values])
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            small, large = self.levels.pop(), self.levels.pop()
            keys = np.concatenate([large[0], small[0]])
            order = np.argsort(keys, kind="stable")  # two sorted runs: one merge
            self.levels.append([keys[order], *(np.concatenate(pair)[order] for pair in zip(large[1:], small[1:], strict=True))])


def _written(df: DataFrame, name: str) -> DataFrame:
    """`written`, with the write's shuffle files deleted after it instead of at the driver's next garbage collection."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(_CLEANUP, before)


def _cut_long(part: pa.RecordBatch, window: int, piece: int):
    """Bytes and offsets of some texts, and where in the text these begin; one long text comes in overlapping pieces."""
    data, offsets = utf8_view(part.column("text"))
    if part.num_rows > 1 or len(data) <= 2 * piece:
        yield data, offsets, 0
        return
    for base in range(0, len(data) - window + 1, piece):
        some = data[base : base + piece + window - 1]
        yield some, np.array([0, len(some)]), base


def _views(batches, window: int, piece: int = _PIECE):
    """Record batches of some texts with their bytes, offsets and begin (`_cut_long`)."""
    for part in text_pieces(batches, piece):
        for view in _cut_long(part, window, piece):
            yield part, *view


def filed(data: np.ndarray, offsets: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, at most RUN: row, first byte in its row, number, anchor's hash and the run's."""
    codes = _BYTE_CODE[data]
    size, width = len(codes), window - prefix + 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(codes * powers(size), out=sums[1:])
    inverse = _inverse_powers(size)

    def hashed(begin, length):
        return mix64((sums[begin + length] - sums[begin]) * inverse[begin] + np.asarray(length).astype(np.uint64))

    low = np.uint64((1 << (width - 1).bit_length()) - 1)
    best = mix64((sums[prefix:] - sums[: size + 1 - prefix]) * inverse[: size + 1 - prefix] + np.uint64(prefix)) & ~low

    def least(shift):  # the low bits tell how far on the smallest string begins; of equal ones the first
        ahead = best[shift:] + np.uint64(shift)
        return np.minimum(best[: len(best) - shift], ahead, out=ahead)

    reach = 1
    while 2 * reach <= width:
        best = least(reach)
        reach *= 2
    if reach < width:
        best = least(width - reach)
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[:-1][rows] + within
    inside = (best[at] & low).astype(np.int64)
    half = (window - prefix + 1) // 2
    before = inside >= half
    place = at + inside
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (before[1:] != before[:-1])
    run = np.flatnonzero(new)
    anchor = hashed(place[run] - half * before[run], np.where(before[run], prefix + half, window - half + 1))
    row = rows[run]
    apart = np.ones(len(run), bool)
    apart[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])  # a string may come again at once
    anchor, run = anchor[apart], run[apart]
    n = np.diff(np.append(run, len(at)))
    pieces = -(-n // RUN)
    anchor, run = np.repeat(anchor, pieces), _places_by(run, pieces, RUN)
    n = np.diff(np.append(run, len(at)))
    return rows[run], within[run], n, anchor, hashed(at[run], n + window - 1)


def _places_by(begin: np.ndarray, counts: np.ndarray, step: int) -> np.ndarray:
    """begin[k], begin[k] + step, ..., counts[k] of them, for all k."""
    return np.repeat(begin, counts) + step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))


def runs(docs: DataFrame, buckets: int, window: int = WINDOW, prefix: int = PREFIX, held: int = HELD) -> DataFrame:
    """Runs of all windows, many texts to a record: bucket, and lists of their hashes, of their anchors' lower halves and of doc_ids."""

    def packed(parts):
        anchors, hashes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = ((anchors >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        firsts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        bounds = pa.array(np.append(firsts, len(bucket)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (hashes[order].view(np.int64), anchors[order].astype(np.uint32).view(np.int32), ids[order]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[firsts].astype(np.int32)), *lists], ["bucket", "hashes", "anchors", "ids"])

    def run(batches):
        parts, n = [], 0
        for part, data, offsets, _ in _views(batches, window):
            if len(data) < window:
                continue
            rows, _, _, anchors, hashes = filed(data, offsets, window, prefix)
            if len(rows):
                parts.append((anchors, hashes, part.column("doc_id").to_numpy()[rows]))
                n += len(rows)
            if n >= held:
                yield packed(parts)
                parts, n = [], 0
        if parts:
            yield packed(parts)

    return docs.mapInArrow(run, "bucket int, hashes array<long>, anchors array<int>, ids array<long>")


def recurring(sent: DataFrame, hot: int = HOT, batch_size: int = BATCH) -> DataFrame:
    """Runs that are COVERED by a smaller document, and those to be compared (BYTES, HASHES), in their smallest: doc_id, run, kind."""

    def told(ids, hashes, kind):
        kinds = np.broadcast_to(np.asarray(kind, np.int8), len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes.view(np.int64)), pa.array(kinds)], ["doc_id", "run", "kind"])

    def absorb(family, parts):
        hashes, anchors, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, anchors, hashes))
        hashes, anchors, ids = hashes[order], anchors[order], ids[order]
        first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (anchors[1:] != anchors[:-1])])
        keys, filed_at, least = hashes[first], anchors[first], ids[first]
        new = np.ones(len(first), bool)
        for level, mine, at in family.find(keys):
            same = level[1][at] == filed_at[mine]
            mine, at = mine[same], at[same]
            new[mine] = False
            before, now = level[2][at], least[mine]
            later = now < before
            if later.any():
                yield told(before[later], keys[mine[later]], COVERED)
                level[2][at[later]] = now[later]
            least[mine] = np.minimum(before, now)
        covered = ids > np.repeat(least, np.diff(np.append(first, len(ids))))
        if covered.any():
            yield told(ids[covered], hashes[covered], COVERED)
        family.add(keys[new], filed_at[new], least[new])

    def unequal(family):
        hashes, anchors, least = (np.concatenate(x) for x in zip(*family.levels, strict=True))
        order = np.lexsort((least, anchors))
        hashes, anchors, least = hashes[order], anchors[order], least[order]
        first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        count = np.diff(np.append(first, len(anchors)))
        several = np.repeat(least[first] < least[first + count - 1], count)
        if several.any():
            yield told(least[several], hashes[several], np.where(np.repeat(count, count)[several] > hot, HASHES, BYTES))

    def run(batches):
        family, parts, n, now = Family(), [], 0, None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            firsts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
            for first, end in zip(firsts.tolist(), np.append(firsts[1:], len(bucket)).tolist(), strict=True):
                if bucket[first] != now:
                    if parts:
                        yield from absorb(family, parts)
                    if family.levels:
                        yield from unequal(family)
                    family, parts, n, now = Family(), [], 0, bucket[first]
                some = [batch.column(c).slice(first, end - first).flatten().to_numpy() for c in ("hashes", "anchors", "ids")]
                parts.append((some[0].view(np.uint64), *some[1:]))
                n += len(some[0])
                if n >= batch_size:
                    yield from absorb(family, parts)
                    parts, n = [], 0
        if parts:
            yield from absorb(family, parts)
        if family.levels:
            yield from unequal(family)

    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, run long, kind byte")


def _asked(lists: pa.Array, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which runs, by row and hash, are in their rows' lists."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    asked = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ mix64(row.astype(np.uint64))  # equal by chance: one run more
    return np.flatnonzero(np.isin(hashes ^ mix64(rows.astype(np.uint64)), asked))


def window_records(joined: DataFrame, window: int, prefix: int, lengthened: bool) -> DataFrame:
    """Runs of windows that are among `wanted`: prefix (their anchor), doc_id, th, start, n and their bytes, or if lengthened their windows' hashes."""

    def run(batches):
        for part, data, offsets, base in _views(batches, window):
            if len(data) < window:
                continue
            rows, starts, n, anchors, hashes = filed(data, offsets, window, prefix)
            keep = _asked(part.column("wanted"), rows, hashes)
            if not len(keep):
                continue
            begin, rows, n = offsets[:-1][rows[keep]] + starts[keep], rows[keep], n[keep]
            if lengthened:
                sizes, flat = n, sequences(_BYTE_CODE[data], window)[0][_places(begin, n)].view(np.int64)
            else:
                sizes = n + window - 1
                flat = data[_places(begin, sizes)]
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)) if lengthened else pa.BinaryArray.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(anchors[keep].view(np.int64)), part.column("doc_id").take(take), part.column("th").take(take), pa.array((starts[keep] + base).astype(np.int32)), pa.array(n.astype(np.int32)), values], ["prefix", "doc_id", "th", "start", "n", "windows" if lengthened else "bytes"])

    return joined.mapInArrow(run, f"prefix long, doc_id long, th long, start int, n int, {'windows array<long>' if lengthened else 'bytes binary'}")


def suffix_array(records: pa.Array, counts: np.ndarray, window: int) -> np.ndarray:
    """The windows of all records, as byte strings of one width, in order of record and place."""
    sizes = counts + window - 1
    data = np.frombuffer(records.buffers()[2], np.uint8)
    at = np.frombuffer(records.buffers()[1], np.int32)[records.offset : records.offset + len(records)].astype(np.int64)
    assert (sizes == pc.binary_length(records).to_numpy(zero_copy_only=False)).all()
    begins = _places(at, counts)
    return np.lib.stride_tricks.sliding_window_view(data, window)[begins].view(f"S{window}")[:, 0]


def merge_scan(records: DataFrame, window: int = WINDOW, batch_size: int = BATCH) -> DataFrame:
    """Spans of bytes covered by windows that also start in a smaller document: doc_id, th, start, end."""

    def scan(family: Family, held: list[pa.RecordBatch]):
        part = pa.Table.from_batches(held).combine_chunks()
        columns = {c: part.column(c).combine_chunks() for c in part.column_names}
        columns = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
        doc, start, n = (columns[c].to_numpy() for c in ("doc_id", "start", "n"))
        coded = columns["bytes"].dictionary_encode()  # copies of one passage are looked up once
        kind = coded.indices.to_numpy()
        sample = np.unique(kind, return_index=True)[1]  # of each text of a record the first, of the smallest document
        keys = suffix_array(coded.dictionary, n[sample].astype(np.int64), window)
        distinct, inverse = np.unique(keys, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, np.repeat(doc[sample], n[sample]))
        fresh = np.ones(len(distinct), bool)
        for level, mine, at in family.find(distinct):
            fresh[mine] = False
            least[mine] = level[1][at]  # batches come in order of doc_id
        family.add(distinct[fresh], least[fresh])
        lows = least[inverse]
        row = np.repeat(np.arange(part.num_rows), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.cumsum(n[sample]) - n[sample]
        repeated = np.flatnonzero(lows[begin[kind][row] + inside] < doc[row])
        if len(repeated):
            row, at = row[repeated], (start[row] + inside)[repeated]
            cut = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(at)) - 1
            take = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([columns["doc_id"].take(take), columns["th"].take(take), pa.array(at[first].astype(np.int32)), pa.array((at[last] + window).astype(np.int32))], ["doc_id", "th", "start", "end"])

    def run(batches):
        family, held, n = Family(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                held.append(batch.slice(at, 1_000))
                n += int(held[-1].column("n").to_numpy().sum())
                if n >= batch_size:
                    yield from scan(family, held)
                    held, n = [], 0
        if held:
            yield from scan(family, held)

    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(n, "prefix").sortWithinPartitions("doc_id").mapInArrow(run, "doc_id long, th long, start int, end int")


def repeated_bytes(keyed: DataFrame, window: int = WINDOW, prefix: int = PREFIX, hot: int = HOT, batch_size: int = BATCH, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """What is covered by windows that also start in a document with a smaller doc_id: lists of runs (doc_id, covered), and byte spans (doc_id, th, spans).

    keyed holds no two equal texts of different doc_id.
    """
    spark = keyed.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = keyed.where("doc_id is not null")
    found = recurring(runs(named.select("doc_id", "text"), buckets, window, prefix, held), hot, batch_size)
    lists = [F.collect_list(F.when(F.col("kind") == kind, F.col("run"))).alias(name) for name, kind in (("covered", COVERED), ("by_bytes", BYTES), ("by_hash", HASHES))]
    told = _written(found.groupBy("doc_id").agg(*lists), "runs")

    def records(kind: str) -> DataFrame:
        part = told.where(F.size(kind) > 0).select("doc_id", F.col(kind).alias("wanted"))
        texts = marked(named, part, "doc_id").where("marked").drop("marked")
        return window_records(texts.join(part, "doc_id"), window, prefix, kind == "by_hash")

    spans = _written(merge_scan(records("by_bytes"), window, batch_size), "spans")
    spans = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    if told.where(F.size("by_hash") > 0).limit(1).count():
        spans = spans.unionByName(_whole_windows(_written(records("by_hash"), "lengthened"), window))
    return told.where(F.size("covered") > 0).select("doc_id", "covered"), spans


def cut_spans(size: int, spans) -> tuple[np.ndarray, int]:
    """Begin and end of what is left of `size` bytes, and the number of maximal removed runs."""
    if not len(spans):
        return np.array([[0, size]]), 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    begin, end = spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]
    return np.stack([np.append(0, end), np.append(begin, size)], 1), len(begin)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, hot: int = HOT, batch_size: int = BATCH, held: int = HELD, keep: bool = True) -> DataFrame:
    """Documents without the bytes that repeated_bytes covers: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (keep: kept, the rest's bytes)."""
    keyed = spread(clean_ids(docs, "doc_id", "text")).withColumn("th", F.xxhash64("text"))
    copies = copied(keyed)
    known = marked(keyed, copies, "doc_id", "th")
    firsts = known.where("not marked").drop("marked").unionByName(known.where("marked").drop("marked").join(copies, ["doc_id", "th"], "left_anti").select("doc_id", "text", "th"))
    covered, spans = repeated_bytes(firsts, window, prefix, hot, batch_size, held)
    spans = spans.groupBy("doc_id").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: F.struct("th", x["start"].alias("start"), x["end"].alias("end"))))).alias("spans"))
    spans = _written(spans, "spans")

    def fields(column, *names):
        bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        flat = column.flatten()
        return np.repeat(np.arange(len(column)), np.diff(bounds)), [flat.field(c).to_numpy(zero_copy_only=False) for c in names]

    def gone(part):
        """Row, begin and end of what is repeated."""
        row, (th, start, end) = fields(part.column("spans"), "th", "start", "end")
        mine = np.flatnonzero(th == part.column("th").to_numpy()[row])
        found = [(row[mine], start[mine].astype(np.int64), end[mine].astype(np.int64))]
        copy = np.flatnonzero(part.column("whole").fill_null(False).to_numpy(zero_copy_only=False))
        found.append((copy, np.zeros(len(copy), np.int64), np.full(len(copy), 2**31 - 1)))
        lists = part.column("covered")
        some = part.filter(pc.greater(pc.list_value_length(lists).fill_null(0), 0)) if lists.null_count < len(lists) else part.slice(0, 0)
        back = np.flatnonzero(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        for data, offsets, base in _cut_long(some, window, _PIECE) if some.num_rows else ():
            if len(data) >= window:
                rows, starts, n, _, hashes = filed(data, offsets, window, prefix)
                keep = _asked(some.column("covered"), rows, hashes)
                found.append((back[rows[keep]], starts[keep] + base, starts[keep] + base + n[keep] + window - 1))
        row, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], np.stack([start[order], end[order]], 1)

    def run(batches):
        for part in text_pieces(batches, _PIECE):
            data, offsets = utf8_view(part.column("text"))
            row, flat = gone(part)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            rows = []
            for k, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                size = end - begin
                mine = flat[bounds[k] : bounds[k + 1]] if size >= window else flat[:0]
                left, n = cut_spans(size, np.minimum(mine, size))
                raw = data[begin:end]
                rest = raw.tobytes() if not n else b"".join(raw[i:j].tobytes() for i, j in left.tolist())
                rows.append((size, size - len(rest), n, hashlib.sha256(rest).hexdigest(), rest if keep else None))
            a, b, c, d, e = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (a, b, c)), pa.array(d, pa.string()), *([pa.array(e, pa.binary())] if keep else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep])

    told = marked(known.withColumnRenamed("marked", "copy"), spans.select("doc_id").unionByName(covered.select("doc_id")), "doc_id")
    named = told.where("copy").join(copies.withColumn("whole", F.lit(True)), ["doc_id", "th"], "left")  # every window of a copy is repeated
    kinds = {"whole": "boolean"} | {c: x.schema[c].dataType for x, c in ((spans, "spans"), (covered, "covered"))}
    absent = {c: F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()}
    columns = ["doc_id", "text", "th"]
    cut = named.select(*columns, "whole").unionByName(told.where("not copy and marked").select(*columns, absent["whole"]))
    cut = cut.join(spans, "doc_id", "left").join(covered, "doc_id", "left").select(*columns, *kinds)
    plain = told.where("not copy and not marked").select(*columns, *absent.values())  # a null doc_id among them
    return cut.unionByName(plain).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)


def op11_suffix_array_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), keep=False)
