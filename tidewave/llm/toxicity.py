"""Toxic documents by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel compares two stretches of text by the subsequences of three signs that they share, gaps included: a subsequence
that spans s signs (up to SPAN) counts DECAY**s, its start and its end are signs too, and the kernel is normalised. A stretch is a white-space token's letters
and digits in lower case, so other signs put between them fall away; two neighbouring tokens of at most JOINED letters
together, one of at most PART, neither a common word of three letters or more, are read as one stretch too, and so are three or more single letters in a
row: spaces put inside don't hide a word. Stretches over LONG letters are read in overlapping windows.

Training is on labelled sentences, of which only some stretches are meant: in the sentences of toxic documents those far
more frequent there (at least SEEN times, at a share RATIO times that of clean ones) are the positive ones, each with
VARIANTS copies that have a letter put in, left out, doubled or replaced, so that the margin holds for what the kernel is
to tolerate; those of clean documents are negative, and after each of ROUNDS fits the ones that score highest join.
LANDMARKS of both kinds span the Nyström space; the machine is fitted in it by Newton steps on the squared hinge. As the
features are explicit, the machine folds into one weight for each subsequence, so scoring a stretch costs its own
subsequences, however many landmarks there are. A document's probability comes from its stretches' margins (the three
highest of different ones, the sum of all positive ones, its length) by a logistic fit on the same rows.

Labels are learnt from rows whose crc32(doc_id as text) mod 3 is not 1 alone, at most SAMPLE of them (those with the
smallest hashes of doc_id). Their texts stay in the tasks: counts of stretches come from there, and the driver gets at most
POSITIVES positive, 2 * POOL clean ones and five numbers for each row. Scoring reads every stretch of every whole text.
Neither labels, lang, source nor doc_id is an input of a score.

Defined results: null text counts as empty, and empty texts share one score; a null doc_id stays null and counts as not
held out; repeated rows give repeated rows, and labelled ones count once; of a text with several labels the highest counts;
stretches that tie are taken in order of their letters; very long texts are read whole, piece by piece; an empty table
gives none; without labels of both kinds every score is 0; null labels are skipped; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm._common import clean_ids, mix64, powers, spread, table, text_pieces, written
from tidewave.llm.quality import HELD, held_out

SPAN = 5
DECAY = 0.7
LONG = 24
JOINED, PART = 12, 4
LANDMARKS = 600
#: Labelled documents that the machine is fitted on.
SAMPLE = 5_000
#: Bounds of the fit on those documents: positive stretches, and clean ones, half of them the most frequent, to choose negative ones from.
POSITIVES = 600
POOL = 30_000
#: How many clean stretches are negative at first, and how many join after each round.
STARTERS, HARDEST = 3_000, 1_500
SEEN, RATIO = 4, 12
VARIANTS = 20
CUT = 0.7
#: Words that a worker remembers the margins of; beyond it the memory starts afresh.
REMEMBERED = 1_000_000
ROUNDS = 4
#: Margins below it count as it; a text with fewer than three different stretches has it in the missing places.
_FLOOR = -2.0
#: Bits that tell subsequences apart.
_HASH = 42
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_HEAD = np.zeros(0x3100, bool)
_HEAD[0x30:0x3A] = True
_HEAD[0x61:0x7B] = True
_HEAD[0xC0:] = True
_HEAD[[0xD7, 0xF7]] = False
_HEAD[0x2000:0x2070] = False
_HEAD[0x3000:0x3040] = False


def words(texts: list[str], common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all stretches, and each one's row, first letter, length and hash.

    Stretches of two tokens come after all others, and only if the hashes of common words (ascending) are given.
    """
    joined = "\n".join(texts).lower()
    own = [t.lower() for t in texts]
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.asarray([len(t) for t in own], np.int64) + 1
    if len(codes) != sizes.sum() - 1:  # lower case depends on what follows in a few scripts
        codes = np.frombuffer("\n".join(own).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(sizes)
    letter = (codes >= 0x3100) | _HEAD[np.minimum(codes, 0x30FF)]
    letter[codes >= 0xFF00] = False
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0)
    token = np.cumsum(space)[letter]
    place = np.flatnonzero(letter)
    if not len(token):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint32), none, none, none, np.zeros(0, np.uint64)
    letters = codes[place]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    lengths = np.diff(np.append(first, len(token)))
    spoken = np.add.reduceat((letters > 0x39).astype(np.int64), first) > 0  # not digits alone
    token, first, lengths = token[first][spoken], first[spoken], lengths[spoken]
    rows = np.searchsorted(ends, place[first], side="right")
    last = first + lengths
    single = lengths == 1
    if single.any():  # runs of single letters make one word
        starts = np.append(True, ~(single[1:] & single[:-1] & (token[1:] == token[:-1] + 1) & (rows[1:] == rows[:-1])))
        group = np.cumsum(starts) - 1
        many = np.bincount(group)[group] >= 3
        keep = starts | ~many
        final = np.append(keep[1:], True)
        token, first, rows, last = token[keep], first[keep], rows[keep], last[final]
        lengths = last - first
    beside = np.flatnonzero((token[1:] == token[:-1] + 1) & (rows[1:] == rows[:-1]) & (lengths[1:] + lengths[:-1] <= JOINED) & (np.minimum(lengths[1:], lengths[:-1]) <= PART) & (first[1:] == last[:-1]))
    whole = first, lengths, rows
    long = lengths > LONG
    if long.any():
        n = np.where(long, -(-(lengths - LONG) // (LONG // 2)) + 1, 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows, first, lengths = (np.repeat(x, n) for x in (rows, first, lengths))
        shift = nth * (LONG // 2)
        first, lengths = first + shift, np.minimum(lengths - shift, LONG)
    hashes = _hashes(letters, first, lengths)
    if common is not None and len(beside):
        short = whole[1] <= LONG
        known = np.zeros(len(short), bool)
        known[short] = _among(hashes if not long.any() else _hashes(letters, whole[0][short], whole[1][short]), common)
        known &= whole[1] > 2
        beside = beside[~(known[beside] | known[beside + 1])]
        more = whole[0][beside], whole[1][beside] + whole[1][beside + 1]
        first, lengths, rows = np.append(first, more[0]), np.append(lengths, more[1]), np.append(rows, whole[2][beside])
        hashes = np.append(hashes, _hashes(letters, *more))
    return letters, rows, first, lengths, hashes


def _hashes(letters: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    mixed = mix64(letters[np.repeat(first, lengths) + at].astype(np.uint64) + _A) * powers(LONG)[at]
    return mix64(np.add.reduceat(mixed, begin) + lengths.astype(np.uint64))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


def coded(listed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, first letter and length of stretches given one by one."""
    lengths = np.asarray([len(x) for x in listed], np.int64)
    return np.frombuffer("".join(listed).encode("utf-32-le"), "<u4"), np.cumsum(lengths) - lengths, lengths


def variants(word: str, n: int, rng: np.random.RandomState) -> list[str]:
    """n copies of a word with one or, if it is long, two letters put in, left out, doubled or replaced."""
    alphabet, out = "abcdefghijklmnopqrstuvwxyz0134578", []
    for k in range(n):
        made = word
        for _ in range(1 + (len(word) > 7 and k % 5 == 0)):
            i = int(rng.randint(1, len(made)))
            sign = alphabet[rng.randint(len(alphabet))]
            put, left = made[:i] + sign + made[i:], made[:i] + made[i + 1 :]
            made = (put, made[:i] + sign + made[i + 1 :], made[:i] + made[i - 1] + made[i:], made[:i] + sign + made[i + 1 :], left if len(made) > 4 else put)[k % 5]
        out.append(made[:LONG])
    return out


def features(letters: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch (of at most 500,000), subsequence and weight, normalised. A stretch's two ends count as signs of their own."""
    sizes = lengths + 2
    begin = np.cumsum(sizes) - sizes
    whole = np.full(sizes.sum(), 1, np.uint64)
    whole[begin + sizes - 1] = 2
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole[np.repeat(begin + 1, lengths) + at] = letters[np.repeat(first, lengths) + at]
    one, two, three = whole * _A, whole * _B, whole * _C
    last = np.repeat(begin + sizes, sizes)
    place, owner = np.arange(len(whole)), np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) << np.uint64(_HASH + 3)
    found = []
    for a, b in _STEPS:
        at = place[: len(place) - a - b][(place + a + b < last)[: len(place) - a - b]] if len(place) > a + b else place[:0]
        found.append(owner[at] | (mix64(one[at] + two[at + a] + three[at + a + b]) >> np.uint64(64 - _HASH) << np.uint64(3)) | np.uint64(a + b - 2))
    found = np.sort(np.concatenate(found))  # stretch, subsequence, span
    values = DECAY ** np.arange(3, 11)[(found & np.uint64(7)).astype(np.int64)]
    found >>= np.uint64(3)
    new = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
    found, values = found[new], np.add.reduceat(values, new) if len(new) else values
    owner = (found >> np.uint64(_HASH)).astype(np.int64)
    norm = np.sqrt(np.bincount(owner, values * values, len(first)))
    return owner, found & np.uint64((1 << _HASH) - 1), values / norm[owner]


class Machine:
    """Weights of subsequences: margin(word) = sum of weight * feature + bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, common: np.ndarray):
        order = np.argsort(keys)
        self.common = common
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.known: dict[int, float] = {}

    def margins(self, letters: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        owner, keys, values = features(letters, first, lengths)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys
        return np.bincount(owner[hit], values[hit] * self.weights[at[hit]], len(first)) + self.bias

    def describe(self, texts: list[str]) -> np.ndarray:
        """Of each text: the three highest margins of different stretches, the sum of positive ones, log of the number of stretches."""
        out = np.full((len(texts), 5), _FLOOR)
        out[:, 3:] = 0
        letters, rows, first, lengths, hashes = words(texts, self.common)
        if not len(rows):
            return out
        out[:, 4] = np.log1p(np.bincount(rows, minlength=len(texts)))
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        listed = distinct.tolist()
        if len(self.known) > REMEMBERED:
            self.known = {}
        get = self.known.get
        found = np.asarray([get(h, np.nan) for h in listed])
        new = np.flatnonzero(np.isnan(found))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            found[some] = np.maximum(self.margins(letters, first[at[some]], lengths[at[some]]), _FLOOR)
            self.known.update(zip((listed[k] for k in some), found[some].tolist(), strict=True))
        margins = found[back]
        high = np.flatnonzero(margins > _FLOOR)
        order = high[np.lexsort((back[high], -margins[high], rows[high]))]
        order = order[np.append(True, (rows[order][1:] != rows[order][:-1]) | (back[order][1:] != back[order][:-1]))] if len(order) else order
        begin = np.flatnonzero(np.append(True, rows[order][1:] != rows[order][:-1])) if len(order) else order
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        top = rank < 3
        out[rows[order[top]], rank[top]] = margins[order[top]]
        out[:, 3] = np.bincount(rows[order], np.clip(margins[order], 0, 1), len(texts))
        return out


def _dense(rows: np.ndarray, keys: np.ndarray, values: np.ndarray, n: int, table_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table_, keys)
    at[at == len(table_)] = 0
    hit = table_[at] == keys
    out = np.zeros((n, len(table_)), np.float32)
    out[rows[hit], at[hit]] = values[hit]
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights (the last one the bias, whose column of x is 1) that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y f)^2, by Newton steps.

    x may be of single precision; sums over its rows go block by block in double.
    """
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    blocks = [slice(i, i + 2_000) for i in range(0, len(x), 2_000)]
    gaps = lambda w: np.concatenate([np.maximum(0, 1 - y[b] * (x[b].astype(np.float64) @ w)) for b in blocks])
    gap = gaps(w)
    loss = w @ ridge @ w / 2 + (cost * gap**2).sum()
    for _ in range(steps):
        slope, bend = ridge @ w, ridge.copy()
        for b in blocks:
            on = gap[b] > 0
            part, weight = x[b][on].astype(np.float64), cost[b][on]
            bend += 2 * (part.T * weight) @ part
            slope -= 2 * part.T @ (weight * gap[b][on] * y[b][on])
        step, size = np.linalg.solve(bend, slope), 1.0
        while True:
            new = w - size * step
            new_gap = gaps(new)
            new_loss = new @ ridge @ new / 2 + (cost * new_gap**2).sum()
            if new_loss <= loss or size <= 1e-4:
                break
            size /= 2
        w, gap, loss = new, new_gap, new_loss
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def train_words(positive: list[tuple[str, int]], pool: list[str], common: int, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine | None:
    """The machine of stretches; None if none is typical of toxic texts. The first `common` of the pool are its common words.

    Positive ones come with how often they were seen; the more often, the dearer it is to miss them and their variants.
    """
    if not positive:
        return None
    rng = np.random.RandomState(5)
    clean = set(pool[:common])
    made = [(v, t) for w, t in positive for v in variants(w, VARIANTS, rng) if v not in clean]
    sure = np.asarray([8 * t / (t + 10) for _, t in positive] + [3 * t / (t + 10) for _, t in made])
    positive, copies = [w for w, _ in positive], [v for v, _ in made]
    n, m = len(positive), len(positive) + len(copies)
    letters, first, lengths = coded(positive + copies + pool)
    known = np.sort(_hashes(letters, first[m : m + common], lengths[m : m + common]))
    every = np.arange(m, m + len(pool))
    negative, hardest = every[:STARTERS], np.zeros(0, np.int64)
    machine = None
    for _ in range(rounds):
        chosen = np.concatenate([np.arange(m), negative])
        y = np.where(chosen < m, 1.0, -1.0)
        cost = np.concatenate([sure, np.full(len(negative), 2.0)])
        marks = np.concatenate([np.arange(n)[: landmarks // 4], n + rng.permutation(m - n)[: landmarks // 4], hardest[: landmarks // 4], negative[: landmarks // 4]])
        z_rows, z_keys, z_values = features(letters, first[marks], lengths[marks])
        vocabulary = np.unique(z_keys)
        z = _dense(z_rows, z_keys, z_values, len(marks), vocabulary).astype(np.float64)
        values, vectors = np.linalg.eigh(z @ z.T)
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        x = np.ones((len(chosen), root.shape[1] + 1), np.float32)
        for i in range(0, len(chosen), 500):
            c = chosen[i : i + 500]
            x[i : i + len(c), :-1] = _dense(*features(letters, first[c], lengths[c]), len(c), vocabulary) @ z.T @ root
        w = svm(x, y, cost)
        machine = Machine(vocabulary, z.T @ (root @ w[:-1]), float(w[-1]), known)
        margins = np.concatenate([machine.margins(letters, first[every[i : i + 20_000]], lengths[every[i : i + 20_000]]) for i in range(0, len(every), 20_000)])
        hardest = every[np.lexsort((every, -margins))[:HARDEST]]
        negative = np.concatenate([negative, np.setdiff1d(hardest, negative)])
    return machine


class Detector:
    """Score of a text: logistic function of what Machine.describe tells. Without a machine every score is 0."""

    def __init__(self, machine: Machine | None = None, told: np.ndarray | None = None, toxic: np.ndarray | None = None):
        self.machine = machine
        if machine is None:
            return
        self.sizes = float(told[:, 4].min()), float(told[:, 4].max())
        x = self.inputs(told)
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(x.shape[1]), x.T @ (p - toxic) + 0.05 * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        machine.known = {}

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What the logistic fit sees; lengths beyond those it was fitted on count as the nearest of them."""
        positive = np.clip(x[:, :3], -1, 2)
        density = np.minimum(x[:, 3] / np.maximum(np.expm1(x[:, 4]), 1), 0.5) * 4
        size = np.clip(x[:, 4], *self.sizes) - 5
        return np.column_stack([positive, np.minimum(x[:, 3], 6) / 2, density, (positive[:, 0] > 0) * size, size, np.ones(len(x))])

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.machine is None:
            return np.zeros(len(texts))
        told = (self.inputs(self.machine.describe(texts)) * self.weights).sum(1)  # row by row: equal texts, equal scores
        return 1 / (1 + np.exp(-np.clip(told, -40, 40)))


def counted_words(rows: DataFrame) -> DataFrame:
    """Of each stretch of the rows (text, label): how often it stands in texts of label 0 (n) and of label 1 (t).

    It counts once for each different one before it, in the texts of label 0 if both kinds have the two, so that copies of
    a passage don't make its words look typical.
    """

    def run(batches):
        for batch in batches:
            for part in text_pieces([batch], 1 << 19):
                letters, own, first, lengths, found = words(part.column("text").to_pylist())
                before = np.append(np.uint64(0), found[:-1])[: len(found)]
                before[np.flatnonzero(np.append(True, own[1:] != own[:-1]))[: len(found)]] = 0
                label = part.column("label").to_numpy()[own]
                _, once = np.unique(mix64(found) + mix64(before * _A) + label.astype(np.uint64), return_index=True)
                text = letters.astype("<u4").tobytes().decode("utf-32-le")
                listed = [text[i : i + k] for i, k in zip(first[once].tolist(), lengths[once].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(listed, pa.string()), pa.array(before[once].view(np.int64)), pa.array(label[once].astype(np.int32))], ["word", "before", "label"])

    pairs = rows.mapInArrow(run, "word string, before long, label int").groupBy("word", "before").agg(F.min("label").alias("label"))
    return pairs.groupBy("word").agg(F.sum(F.expr("1 - label")).alias("n"), F.sum("label").alias("t"))


def first_words(counts: DataFrame, count: str, limit: int, order: Column) -> list[tuple[str, int]]:
    """The first `limit` stretches by order and letters, with their count, the most frequent first.

    They come as Arrow batches of one task that merges every task's first ones; collect() would merge these in the driver.
    """
    found = counts.orderBy(order, "word").limit(limit).select("word", F.col(count).alias("times")).toArrow()
    return sorted(zip(found["word"].to_pylist(), found["times"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> Detector:
    """A detector from the labelled rows that aren't held out, at most `limit` of them."""
    known = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where(f"label is not null and doc_id is not null and not ({HELD})")
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("label").alias("label"))
    rows = written(spread(texts), "labelled")
    if rows.agg(F.countDistinct("label")).first()[0] < 2:
        return Detector()
    counts = written(counted_words(rows), "counts")
    sums = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    share_t, share_n = F.col("t") / max(sums.t or 0, 1), (F.col("n") + 0.5) / max(sums.n or 0, 1)
    able = counts.where(F.length("word") >= 3)
    positive = first_words(able.where((F.col("t") >= SEEN) & (share_t > RATIO * share_n)), "t", POSITIVES, F.desc("t"))
    clean = able.where((F.col("n") > 0) & (share_t < 4 * share_n))
    common = [w for w, _ in first_words(clean, "n", POOL, F.desc("n"))]
    others = {w for w, _ in first_words(clean, "n", POOL, F.xxhash64("word"))}
    machine = train_words(positive, common + sorted(others - set(common)), len(common))
    if machine is None:
        return Detector()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def describe(batches):
        for batch in batches:
            for part in text_pieces([batch], 1 << 19):
                told = shared.value.describe(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in told.T), part.column("label")], [*"abcde", "label"])

    told = np.asarray([tuple(r) for r in rows.mapInArrow(describe, "a double, b double, c double, d double, e double, label int").collect()])
    told = told[np.lexsort(told.T)]  # the same sums whatever order the rows come in
    return Detector(machine, told[:, :5], told[:, 5])


def scores(docs: DataFrame, detector: Detector) -> DataFrame:
    """docs, `text` among its columns and none called score, with a column `score` more."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            values = [np.zeros(0)]
            for part in text_pieces([batch.select(["text"])], 1 << 19):
                values.append(shared.value(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted, for every document."""
    docs = clean_ids(docs, "doc_id", "text")
    scored = scores(spread(docs), fit(docs, labels, limit=limit))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """docs, all columns, without those whose score reaches CUT."""
    detector = fit(clean_ids(docs, "doc_id", "text"), labels, limit=limit)
    held = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return scores(spread(held), detector).where(F.col("score") < CUT).select("row.*")


def op10_subsequence_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
