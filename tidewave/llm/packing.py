"""Best-fit packing of documents into training sequences: greedy matching of large items, best fit for the rest.

Items longer than a third of the capacity go at most two to a sequence, so placing them is a matching: from the
longest down, each takes the longest partner that still fits. Shorter items then go, longest first, each to the fullest
sequence with room for it. Both steps depend only on how many items have each length, so the plan is made from the
histogram of lengths (at most `capacity` rows, whatever the size of the input), with runs of like sequences handled as one;
Spark then ranks the items of each length and looks each rank up in the plan.

Defined results: a null text counts as empty and gives the end id alone; a null doc_id is kept as null; repeated rows are
packed once each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm._common import _SPACE, clean_ids, spread, table, text_pieces, utf8_view, word_view, written

CAPACITY = 2048
END_ID = 0
#: Salts over which items of one length are ranked, so that one length may hold any share of the rows.
SALTS = 1024
#: Items of one length and salt at most, on average: with more items of a length there are more salts.
PER_SALT = 1_000_000
#: Words that a worker remembers the ids of; beyond it the memory starts afresh.
REMEMBERED = 300_000
#: Stands between words that go through the library together, so many in a line; words that hold it go alone.
SEPARATOR, TOGETHER = "\0", 64
#: Marks that may be cut off words, and the patterns of pre-tokens by which that changes no id: a run of letters ends before them, a run of marks begins with them.
MARKS = ".,;:!?*#%&$)"
LETTERS_AND_MARKS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK, _LETTER = (np.isin(np.arange(256), [*x]) for x in (MARKS.encode(), bytes([*range(65, 91), *range(97, 123)])))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of whole texts by a `tokenizers` file that drops white space.

    White space always separates pre-tokens there, so texts are cut at it and each distinct word goes through the library
    once per worker, many at a time with SEPARATOR between them. Where the file lowers case, A to Z are lowered first; where
    letters and marks are pre-tokens of their own, MARKS at a word's end after one of a to z are a word of their own. Words
    are told apart by 64-bit hashes within one memory of REMEMBERED words (odds of a clash: one in 10**8 for a full memory);
    a full one keeps those that came again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        told = json.loads(self.tokenizer.to_str())
        steps = lambda x, name: (x or {}).get(name, [x] if x else [])
        normal, cuts = steps(told["normalizer"], "normalizers"), steps(told["pre_tokenizer"], "pretokenizers")
        plain = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in normal)
        added = "".join(x["content"] for x in told["added_tokens"])
        self.lowers = plain and any(x["type"] == "Lowercase" for x in normal) and added == added.lower()
        self.parts_marks = plain and bool(cuts) and cuts[0].get("pattern") in ({"Regex": x} for x in LETTERS_AND_MARKS) and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not set(added) & set(MARKS)
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots, self.again = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)  # by hash
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # slot k's ids: first[k] to first[k + 1]

    def trim(self) -> None:
        """Keep the words that came again since the last time; none if they are more than half of what is remembered."""
        slots = self.slots[self.again]
        if 2 * len(slots) > REMEMBERED:
            return self.forget()
        keys, sizes = self.keys[self.again], self.first[slots + 1] - self.first[slots]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.first[slots] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        self.forget()
        self.keys, self.slots, self.again, self.first, self.ids = keys, np.arange(len(keys)), np.zeros(len(keys), bool), bounds, ids

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        together = self.mark is not None and not any(SEPARATOR in w for w in words)
        lines = [f" {SEPARATOR} ".join(words[i : i + TOGETHER]) + f" {SEPARATOR} " for i in range(0, len(words), TOGETHER)] if together else words
        found = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        if not together:
            return np.concatenate(found), np.asarray([len(x) for x in found])
        flat = np.concatenate(found)
        ends = np.flatnonzero(flat == self.mark)
        return flat[flat != self.mark], np.diff(ends, prepend=-1) - 1

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Take words of sorted hashes that aren't remembered."""
        odd = np.asarray([SEPARATOR in w for w in words])
        groups = [np.flatnonzero(odd == side) for side in (False, True)]
        held, counts = [self.ids], []
        for group in groups:
            if len(group):
                ids, n = self._encoded([words[k] for k in group.tolist()])
                held.append(ids)
                counts.append(n)
        slots = np.empty(len(words), np.int64)
        slots[np.concatenate(groups)] = len(self.first) - 1 + np.arange(len(words))
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.slots, self.again = np.insert(self.keys, at, hashes), np.insert(self.slots, at, slots), np.insert(self.again, at, False)
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.concatenate(counts)))
        self.ids = np.concatenate(held)

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes among the keys, and whether they are there."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word_view, with the marks at words' ends as words of their own."""
        cuts = None
        if self.parts_marks and len(data):
            marks = np.concatenate([[False], _MARK[data], [False]])
            begins, ends = np.flatnonzero(marks[1:] & ~marks[:-1]), np.flatnonzero(marks[:-1] & ~marks[1:])
            row_ends = np.zeros(len(data) + 1, bool)
            row_ends[offsets] = True
            closed = row_ends[ends] | _SPACE[data[np.minimum(ends, len(data) - 1)]]
            cuts = begins[closed & _LETTER[data[begins - 1]] & ~row_ends[begins]]
            # a run of marks over the end of a row is left whole
        return word_view(data, offsets, cuts)

    def __call__(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END_ID after each, and where each text's ids start (texts + 1 numbers)."""
        data, offsets = utf8_view(texts)
        if self.lowers:
            data = _LOWER[data]
        starts, ends, hashes, firsts = self._words(data, offsets)
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        place, known = self._known(distinct)
        if not known.all():
            if len(self.keys) > REMEMBERED:
                self.trim()
                place, known = self._known(distinct)
            self.again[place[known]] = True
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)
            self.learn([raw[i:j].decode() for i, j in spans], distinct[new])
            place, _ = self._known(distinct)
        else:
            self.again[place] = True
        word = self.slots[place][back]
        sizes = self.first[word + 1] - self.first[word]
        before = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(len(texts)), np.diff(firsts))
        bounds = before[firsts] + np.arange(len(texts) + 1)
        out = np.full(bounds[-1], END_ID, np.uint32)
        flat = np.arange(before[-1])
        out[flat + np.repeat(row, sizes)] = self.ids[np.repeat(self.first[word] - before[:-1], sizes) + flat]
        return out, bounds


_encoders: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids of each document, whose ids end with END_ID."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        encode = _encoders.setdefault(path, WordIds(path))
        for part in text_pieces(batches):
            ids, bounds = encode(part.column("text"))
            n = -(-np.diff(bounds) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(np.diff(bounds)[row] - start, capacity)
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            begin = (bounds[:-1][row] + start) * 4
            codes = [zlib.crc32(raw[i : i + k]) for i, k in zip(begin.tolist(), (4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(codes, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(clean_ids(docs, "doc_id", "text")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the items of each length go: rows (length, first rank, items, items per sequence, first sequence, offset).

    Rank r of the run goes to sequence `first sequence + (r - first rank) // per`, at `offset + (r - first rank) % per * length`.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    sequences = 0

    def put(length: int, items: int, per: int, first: int, offset: int) -> None:
        runs.append((length, used[length], items, per, first, offset))
        used[length] += items
        left[length] -= items

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_by_room:
                insort(rooms, room)
            open_by_room.setdefault(room, []).append((first, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    rising = large[::-1]
    for a in large:
        while left[a]:
            k = bisect_left(rising, min(a, capacity - a) + 1) - 1
            while k >= 0 and (left[rising[k]] == 0 or (rising[k] == a and left[a] < 2)):
                if left[rising[k]] == 0:
                    rising.pop(k)
                k -= 1
            b = rising[k] if k >= 0 else 0
            if b == a:
                n = left[a] // 2
                put(a, 2 * n, 2, sequences, 0)
            elif b:
                n = min(left[a], left[b])
                put(a, n, 1, sequences, 0)
                put(b, n, 1, sequences, a)
            else:
                n = left[a]
                put(a, n, 1, sequences, 0)
            leave(capacity - a - b, sequences, n)
            sequences += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            k = bisect_left(rooms, a)
            if k == len(rooms):
                per = capacity // a
                n = max(1, left[a] // per)
                first, room, sequences = sequences, capacity, sequences + n
            else:
                room = rooms[k]
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(k)
                per = room // a
            full = min(n, left[a] // per)
            if full:
                put(a, full * per, per, first, capacity - room)
                leave(room - per * a, first, full)
                first, n = first + full, n - full
            if n and left[a]:
                rest = left[a]
                put(a, rest, rest, first, capacity - room)
                leave(room - rest * a, first, 1)
                first, n = first + 1, n - 1
            leave(room, first, n)
    return np.asarray(sorted(runs), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence and its offset there. `pieces` is read three times: pass a written table."""
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(counts, capacity)
    salts = max(SALTS, -(-max(counts.values(), default=0) // PER_SALT))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("salt", salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(shifts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("shift"))
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # a few runs for each of at most `capacity` lengths

    def place(batches):
        found = shared.value
        keys = found[:, 0] << 48 | found[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = found[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
