"""Repeated passages, found with prefix-partitioned suffix trees over words.

The suffixes are the word positions of all texts, cut off after WINDOW words, since only repeats of at least that length
count: an inner node that deep is a window that stands at several places. Every window is filed under the smallest (by
hash) of the PREFIX-word sequences inside it, so equal windows share that prefix and neighbouring windows mostly do too,
and one record holds a run of them, at most RUN. Prefixes that occur in a single document need no tree. The others are
dealt out by prefix, and the records carry the words themselves: each task reads its prefixes in order, sorts the suffixes
below as many as fit its memory by their words (ranks of 1, 2, 4 and up to 32 words by doubling), takes the common
prefixes of neighbours, and every node at depth WINDOW gives the smallest document under it; neighbouring flagged windows
make a maximal repeat. Prefixes have two lengths: one with more than HOT suffixes is lengthened to all WINDOW words, where
each group is a node of its own that needs its smallest document only; lists of windows are grouped before they are dealt.

Equal texts have one tree place: the smallest doc_id's row stands for all, and in the others every window is repeated.
Prefixes and the windows of lengthened ones go by 64-bit hashes, a window always together with its prefix; within a tree
words are told apart by 64-bit hashes among the words of one task.

Defined results: null text has no words; a null doc_id is neither smaller nor larger than any, so its row stays whole; rows
with one doc_id are one document; repeated rows are cut alike; very long texts are cut into runs, whatever they repeat; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm._common import _BASE, clean_ids, marked, mix64, powers, spread, table, text_pieces, utf8_view, word_view, written

WINDOW = 50
PREFIX = 16
#: Suffixes of one prefix that a task may gather.
HOT = 200_000
#: Windows of one record.
RUN = 256
#: Suffixes whose subtrees a task builds at a time.
IN_MEMORY = 500_000
_PIECE = 1 << 18
_INVERSE = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSE
    base = pow(_BASE, -1, 2**64)
    while len(_INVERSE) < n:
        _INVERSE = np.concatenate([_INVERSE, _INVERSE * np.uint64(pow(base, len(_INVERSE), 2**64))])
    return _INVERSE[:n]


def sequences(hashes: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length, the hash of as many words from each place on."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(n), out=sums[1:])
    inverse = _inverse_powers(n)
    return [mix64((sums[k:] - sums[: n + 1 - k]) * inverse[: max(n + 1 - k, 0)] + np.uint64(k)) if k <= n else np.zeros(0, np.uint64) for k in lengths]


def windows(hashes: np.ndarray, firsts: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one prefix: row, first word in its row, number; and all windows' hashes, their prefix's, and each run's first window."""
    whole, short = sequences(hashes, window, prefix)
    reach, least = 1, short
    width = window - prefix + 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    counts = np.maximum(np.diff(firsts) - window + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    within = np.arange(len(rows)) - begin[rows]
    at = firsts[:-1][rows] + within
    least, whole = least[at], whole[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
    begun = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(begun, np.diff(np.append(begun, len(at))))) % RUN == 0
    run = np.flatnonzero(new)
    return rows[run], within[run], np.diff(np.append(run, len(at))), whole, least, run


def _words_of(part: pa.RecordBatch):
    data, offsets = utf8_view(part.column("text"))
    return word_view(data, offsets)


def prefix_runs(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Where runs of windows with one prefix start: prefix, doc_id, th, start, n."""

    def run(batches):
        for part in text_pieces(batches, _PIECE):
            _, _, hashes, firsts = _words_of(part)
            if len(hashes) < window:
                continue
            rows, starts, n, _, least, first = windows(hashes, firsts, window, prefix)
            if len(rows):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), part.column("doc_id").take(take), part.column("th").take(take), pa.array(starts.astype(np.int32)), pa.array(n.astype(np.int32))], ["prefix", "doc_id", "th", "start", "n"])

    return docs.mapInArrow(run, "prefix long, doc_id long, th long, start int, n int")


def _suffix_records(joined: DataFrame, window: int, prefix: int, lengthened: bool) -> DataFrame:
    """Records of the runs wanted of each document: prefix, doc_id, th, start, n and their words, or if lengthened their windows' hashes."""

    def run(batches):
        for part in text_pieces(batches, _PIECE):
            part = part.filter(part.column("wanted").is_valid())
            if not part.num_rows:
                continue
            data, offsets = utf8_view(part.column("text"))
            begins, ends, hashes, firsts = word_view(data, offsets)
            rows, starts, n, whole, least, first = windows(hashes, firsts, window, prefix)
            lists = part.column("wanted").combine_chunks() if hasattr(part.column("wanted"), "combine_chunks") else part.column("wanted")
            asked = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            width = np.int64(1 << 40)
            keep = np.flatnonzero(np.isin(rows * width + starts, owner * width + asked))
            if not len(keep):
                continue
            if lengthened:
                sizes = n[keep]
                flat = whole[_places(first[keep], sizes)].view(np.int64)
            else:
                word = firsts[:-1][rows[keep]] + starts[keep]
                begin = begins[word]
                sizes = ends[word + n[keep] + window - 2] - begin
                flat = data[_places(begin, sizes)]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            values = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat)) if lengthened else pa.LargeStringArray.from_buffers(len(keep), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())
            take = pa.array(rows[keep])
            yield pa.RecordBatch.from_arrays([pa.array(least[first[keep]].view(np.int64)), part.column("doc_id").take(take), part.column("th").take(take), pa.array(starts[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)), values], ["prefix", "doc_id", "th", "start", "n", "windows" if lengthened else "text"])

    return joined.mapInArrow(run, f"prefix long, doc_id long, th long, start int, n int, {'windows array<long>' if lengthened else 'text string'}")


def _places(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ..., sizes[k] of them, for all k."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _spans(start: np.ndarray, flagged: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of what flagged windows cover, for windows in order of row and start."""
    at = np.flatnonzero(flagged)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (row[at[1:]] != row[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return row[at[first]], start[at[first]], start[at[last]] + window


def word_ranks(words: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """For each power of two up to `longest`, the rank of as many words from each place on, in the order of the words.

    Places nearer to the end than that rank as if a smallest word followed.
    """
    ranks = {1: np.unique(words, return_inverse=True)[1].astype(np.int64) + 1}
    k = 1
    while 2 * k <= longest:
        behind = np.zeros(len(words), np.int64)
        behind[: max(len(words) - k, 0)] = ranks[k][k:]
        ranks[2 * k] = np.unique(ranks[k] * (len(words) + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    return ranks


def suffix_order(ranks: dict[int, np.ndarray], at: np.ndarray, group: np.ndarray, tie: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at `at`, cut off after `depth` words, by group, words and tie."""
    top = max(ranks)
    return np.lexsort((tie, ranks[top][at + depth - top], ranks[top][at], group))


def common_prefixes(ranks: dict[int, np.ndarray], at: np.ndarray, depth: int) -> np.ndarray:
    """Words (at most `depth`) that each suffix shares with the one before it in the list; 0 for the first."""
    shared = np.zeros(len(at), np.int64)
    a, b = at[:-1], at[1:]
    for k in sorted(ranks, reverse=True):  # depth is under twice the longest
        have = shared[1:]
        fits = have + k <= depth
        step = np.where(fits, have, 0)
        have += np.where(fits & (ranks[k][a + step] == ranks[k][b + step]), k, 0)
    return shared


def subtrees(records: DataFrame, window: int = WINDOW, in_memory: int = IN_MEMORY) -> DataFrame:
    """Spans of words covered by windows that also start in a smaller document: doc_id, th, start, end.

    Each task gathers prefixes up to in_memory suffixes, sorts the suffixes of each and reads the nodes of that depth off
    the common prefixes of neighbours.
    """
    longest = 1 << (window.bit_length() - 1)

    def resolve(held: list[pa.RecordBatch]):
        part = pa.Table.from_batches(held).combine_chunks()
        text = part.column("text").cast(pa.large_string()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        _, _, hashes, firsts = word_view(*utf8_view(text))
        prefix, doc, start, n = (part.column(c).to_numpy() for c in ("prefix", "doc_id", "start", "n"))
        row = np.repeat(np.arange(part.num_rows), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = firsts[row] + inside
        ranks = word_ranks(hashes, longest)
        order = suffix_order(ranks, at, prefix[row], doc[row], window)
        p = prefix[row][order]
        new = common_prefixes(ranks, at[order], window) < window
        new[1:] |= p[1:] != p[:-1]
        new[:1] = True
        node = np.cumsum(new) - 1
        least = doc[row][order][new]
        repeated = np.zeros(len(order), bool)
        repeated[order] = doc[row][order] > least[node]
        rows, first, end = _spans(start[row] + inside, repeated, row, window)
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks().take(take), part.column("th").combine_chunks().take(take), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "th", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                some = batch.slice(at, 1_000)
                prefixes = some.column("prefix").to_numpy()
                if n >= in_memory:  # the last prefix may go on in this batch
                    last = held[-1].column("prefix")[-1].as_py()
                    goes_on = int(np.searchsorted(prefixes, last, side="right"))
                    if goes_on < len(prefixes):
                        yield resolve([*held, some.slice(0, goes_on)] if goes_on else held)
                        some, held, n = some.slice(goes_on), [], 0
                held.append(some)
                n += int(some.column("n").to_numpy().sum())
        if held:
            yield resolve(held)

    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(n, "prefix").sortWithinPartitions("prefix").mapInArrow(run, "doc_id long, th long, start int, end int")


def copied(keyed: DataFrame) -> DataFrame:
    """(doc_id, th) of the rows whose whole text also is that of a smaller doc_id."""
    ids = written(keyed.where("doc_id is not null and text is not null").select("doc_id", "th", F.xxhash64(F.lit(7), "text").alias("t2")), "ids")
    least = ids.groupBy("th", "t2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("th", "t2", "low")
    return written(ids.join(least, ["th", "t2"]).where("doc_id > low").select("doc_id", "th").distinct(), "copies")


def _dealt_windows(lists: DataFrame, together: int) -> DataFrame:
    """The lists' windows by prefix and part of their hashes: prefix, part, lid, low, high, i (places in the list) and w. A prefix with n windows has n / together parts; a record a list and part."""

    def run(batches):
        for batch in batches:
            column = batch.column("windows")
            n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            w = column.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            part = (w.view(np.uint64) % np.repeat(batch.column("parts").to_numpy(), n).astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, row))
            row, part = row[order], part[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])][: len(row)])
            take, bounds = pa.array(row[first]), pa.array(np.append(first, len(row)).astype(np.int32))
            i = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))[order]
            lists = (pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (i.astype(np.int32), w[order]))
            names = ["prefix", "lid", "low", "high"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), pa.array(part[first]), *lists], [*names, "part", "i", "w"])

    parts = lists.groupBy("prefix").agg(F.sum(F.size("windows")).alias("n")).select("prefix", F.expr(f"(n + {together} - 1) div {together}").alias("parts")).where("parts > 1")
    named = lists.join(F.broadcast(parts), "prefix", "left")  # at most one prefix for every `together` windows
    return named.select("prefix", "lid", "low", "high", "windows", F.coalesce("parts", F.lit(1)).cast("long").alias("parts")).mapInArrow(run, "prefix long, lid long, low long, high long, part long, i array<int>, w array<long>")


def _least_documents(dealt: DataFrame) -> DataFrame:
    """Of each record of _dealt_windows the places whose window stands in a smaller document than the list's largest: prefix, lid, i and low, the smallest document."""

    def told(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held)
        prefix, part, low, high = (whole.column(c).to_numpy() for c in ("prefix", "part", "low", "high"))
        n = np.concatenate([b.column("w").value_lengths().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
        i, w = (np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in held]) for c in ("i", "w"))
        key = np.cumsum(np.r_[False, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((low[row], w, key[row]))
        keys, sorted_w = key[row][order], w[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (sorted_w[1:] != sorted_w[:-1])])
        least = np.empty(len(w), np.int64)
        least[order] = np.repeat(low[row][order][first], np.diff(np.append(first, len(w))))
        keep = np.flatnonzero(least < high[row])
        if len(keep):
            kept = row[keep]
            first = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]])
            take, bounds = kept[first], pa.array(np.append(first, len(keep)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(bounds, pa.array(x[keep])) for x in (i, least))
            yield pa.RecordBatch.from_arrays([*(whole.column(c).combine_chunks().take(pa.array(take)) for c in ("prefix", "lid")), *lists], ["prefix", "lid", "i", "low"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # of whole prefixes and parts, but for the last
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, part = batch.column("prefix").to_numpy(), batch.column("part").to_numpy()
            last = int(np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])[-1])
            begins = not held or held[-1].column("prefix")[-1].as_py() != prefix[0] or held[-1].column("part")[-1].as_py() != part[0]
            if last or begins:
                if last:
                    held.append(batch.slice(0, last))
                if held:
                    yield from told(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield from told(held)

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "prefix", "part").sortWithinPartitions("prefix", "part").mapInArrow(run, "prefix long, lid long, i array<int>, low array<long>")


def _whole_windows(records: DataFrame, window: int, together: int = IN_MEMORY) -> DataFrame:
    """Of each record whose prefixes are lengthened to whole windows, the spans of its windows that a smaller document has.

    Copies of a passage have the same list of windows, so lists are grouped first. A list's windows stay together as arrays:
    a task takes the windows of a prefix, or of a part of its windows' hashes where there are more than `together`.
    """
    listed = records.withColumn("lid", F.xxhash64("windows"))
    lists = written(listed.groupBy("prefix", "lid").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("windows").alias("windows")), "lists")
    lows = written(_least_documents(_dealt_windows(lists, together)), "least").withColumn("lows", F.arrays_zip("i", "low"))
    beyond = F.filter(F.col("lows"), lambda x: x["low"] < F.col("doc_id"))
    spans = F.transform(beyond, lambda x: F.struct((F.col("start") + x["i"]).alias("start"), (F.col("start") + x["i"] + window).alias("end")))
    return listed.select("prefix", "lid", "doc_id", "th", "start").join(lows, ["prefix", "lid"]).select("doc_id", "th", spans.alias("spans")).where(F.size("spans") > 0)


def repeated_spans(keyed: DataFrame, window: int = WINDOW, prefix: int = PREFIX, hot: int = HOT, in_memory: int = IN_MEMORY) -> DataFrame:
    """Arrays of word spans, of each (doc_id, th), covered by windows that also start in a document with a smaller doc_id.

    keyed holds no two equal texts of different doc_id (`copied` tells which to leave out).
    """
    runs = written(prefix_runs(keyed.where("doc_id is not null"), window, prefix), "runs")
    shared = runs.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("suffixes")).where("low < high")
    wanted = written(runs.join(shared.select("prefix", "suffixes"), "prefix").groupBy("doc_id", "th", (F.col("suffixes") > hot).alias("hot")).agg(F.sort_array(F.collect_set("start")).alias("wanted")), "wanted")

    def records(part: DataFrame, lengthened: bool) -> DataFrame:
        texts = marked(keyed, part, "doc_id", "th").where("marked").drop("marked")
        return _suffix_records(texts.join(part.select("doc_id", "th", "wanted"), ["doc_id", "th"]), window, prefix, lengthened)

    found = subtrees(records(wanted.where("not hot"), False), window, in_memory)
    found = found.select("doc_id", "th", F.array(F.struct("start", "end")).alias("spans"))
    if wanted.where("hot").limit(1).count():
        found = found.unionByName(_whole_windows(written(records(wanted.where("hot"), True), "lengthened"), window))
    return found


def _cut(keyed: DataFrame, window: int, prefix: int, hot: int, in_memory: int, extra: list[str], keep: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, the columns `extra` of keyed, and with keep the text that is left."""
    plain = keyed.select("doc_id", "text", "th")
    copies = copied(plain)
    known = marked(plain, copies, "doc_id", "th")
    firsts = known.where("not marked").drop("marked").unionByName(known.where("marked").drop("marked").join(copies, ["doc_id", "th"], "left_anti").select("doc_id", "text", "th"))
    spans = repeated_spans(firsts, window, prefix, hot, in_memory).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end")))  # every window of a copy is repeated
    spans = written(spans.unionByName(copies.select("doc_id", "th", whole.alias("spans"))), "spans")

    def run(batches):
        for part in text_pieces(batches):
            rows = []
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = text.encode("utf-8").split()  # bytes.split() cuts at exactly the white space of the definition
                kept = words
                if found and len(words) >= window:
                    stays = np.ones(len(words), bool)
                    for x in found:
                        stays[x["start"] : x["end"]] = False
                    kept = list(compress(words, stays.tolist()))
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), (joined.decode("utf-8") if len(kept) < len(words) else text) if keep else None))
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), *(part.column(x) for x in extra), *([pa.array(d, pa.string())] if keep else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *extra, *["kept"] * keep])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *[keyed.schema[x] for x in extra], *[T.StructField("kept", T.StringType())] * keep])
    told = marked(keyed, spans, "doc_id", "th")
    cut = told.where("marked").join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans", *extra)
    whole = told.where("not marked").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), *extra)  # a null doc_id among them
    return cut.unionByName(whole).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, hot: int = HOT, in_memory: int = IN_MEMORY, keep: bool = True) -> DataFrame:
    """Documents without the words that repeated_spans covers: n_words, n_removed, and the rest's digest (keep: its text)."""
    keyed = spread(clean_ids(docs, "doc_id", "text")).withColumn("th", F.xxhash64("text"))
    return _cut(keyed, window, prefix, hot, in_memory, [], keep)


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, hot: int = HOT, in_memory: int = IN_MEMORY) -> DataFrame:
    """docs, all columns, whose texts (and n_chars) are without those words; a text that loses none stays as it is."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = spread(docs.select("doc_id", "text", row.alias("row"))).withColumn("th", F.xxhash64("text"))
    cut = _cut(keyed, window, prefix, hot, in_memory, ["row"], True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    fixed = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return cut.select(*[fixed[c].alias(c) if c in fixed else F.col(f"row.`{c}`") for c in docs.columns])


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep=False)
