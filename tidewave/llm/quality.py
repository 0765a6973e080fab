"""Document quality: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Tokens are runs of letters, of digits and of other signs as they stand, each with a mark more where it repeats the one
before it. Tokens fall into BUCKETS by hash. Every bucket has a sparse random index vector of DIMENSIONS; its context
vector is the sum of the index vectors of the tokens within WINDOW places of it, over all documents (counts gathered
from the whole corpus, in a table whose size is fixed). A document is the mean of its tokens' unit context vectors, once
plain and once with frequent tokens weighing less. A network of one hidden layer, fitted with numpy on at most SAMPLE
labelled documents, scores it; a temperature fitted on a fifth of them that the weights never saw calibrates the scores.

Labels are learnt from rows whose crc32(doc_id as text) mod 3 is not 1 alone. Neither labels, lang, source nor doc_id
is an input of a score.

Defined results: null text counts as empty, and empty texts share one score; a null doc_id stays null and counts as not
held out; repeated rows give repeated rows; an empty table gives none; without labels of both kinds every score is the
share of label 1 (0.5 if there are none); null labels are skipped; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import _BYTE_CODE, clean_ids, mix64, powers, spread, table, text_pieces, utf8_view, written

BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 2
WINDOW = 2
#: Labelled documents, those with the smallest hashes of doc_id, that the network is fitted on.
SAMPLE = 8_000
HIDDEN = 16
_REPEAT = np.uint64(0x5DEECE66D)
_CLASS = np.full(256, 3, np.uint8)
_CLASS[:33] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_index = np.random.RandomState(7)
_PLACE = _index.randint(0, DIMENSIONS, (BUCKETS, NONZERO))
_SIGN = _index.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every token of the texts, in order."""
    data, offsets = utf8_view(part.column("text"))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, len(data)))
    codes = _BYTE_CODE[data] * powers(int(lengths.max()))[np.arange(len(data)) - np.repeat(starts, lengths)]
    hashes = mix64(np.add.reduceat(codes, starts) + lengths.astype(np.uint64))
    real = kind[starts] > 0
    starts, hashes = starts[real], hashes[real]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])) + 1
    buckets = hashes % np.uint64(BUCKETS)
    buckets[again] = mix64(hashes[again] * np.uint64(0) + _REPEAT) % np.uint64(BUCKETS)  # a repeat is a token of its own
    return rows, buckets.astype(np.int64)


def _added(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Context vectors of one piece, with the number of tokens as the last column."""
    keys, signs = [], []
    for step in range(1, WINDOW + 1):
        near = rows[step:] == rows[:-step]
        a, b = own[:-step][near], own[step:][near]
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                keys.append(x * DIMENSIONS + _PLACE[y, k])
                signs.append(_SIGN[y, k])
    sums = np.bincount(np.concatenate(keys), np.concatenate(signs), BUCKETS * DIMENSIONS)
    return np.column_stack([sums.reshape(BUCKETS, DIMENSIONS), np.bincount(own, minlength=BUCKETS)])


def context_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit context vector of each bucket, and its share of all tokens; a table of BUCKETS rows."""
    names = [f"d{i}" for i in range(DIMENSIONS)] + ["n"]

    def gather(batches):
        total = np.zeros((BUCKETS, DIMENSIONS + 1))
        for part in text_pieces(batches, 1 << 22):
            rows, own = tokens(part)
            if len(own):
                total += _added(rows, own)
        some = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, i].astype(np.int64)) for i in range(DIMENSIONS + 1))], ["bucket", *names])

    found = docs.select("text").mapInArrow(gather, "bucket int, " + ", ".join(f"{n} long" for n in names))
    sums = found.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    vectors, times = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS)
    if len(sums):
        own = sums["bucket"].to_numpy()
        vectors[own] = sums[names[:-1]].to_numpy(np.float64)
        times[own] = sums["n"].to_numpy(np.float64)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32), (times / max(times.sum(), 1)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, shares: np.ndarray) -> DataFrame:
    """doc_id and the document's vector of 2 * DIMENSIONS."""
    weight = (1e-3 / (1e-3 + shares)).astype(np.float32)
    both = np.concatenate([vectors, vectors * weight[:, None]], axis=1)
    shared = docs.sparkSession.sparkContext.broadcast(both)

    def run(batches):
        for part in text_pieces(batches, 1 << 19):
            rows, own = tokens(part)
            out = np.zeros((part.num_rows, 2 * DIMENSIONS), np.float32)
            if len(own):
                begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                out[rows[begin]] = np.add.reduceat(shared.value[own], begin, axis=0, dtype=np.float64) / np.diff(np.append(begin, len(rows)))[:, None]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), 2 * DIMENSIONS).cast(pa.list_(pa.float32()))], ["doc_id", "vector"])

    return docs.mapInArrow(run, "doc_id long, vector array<float>")


class Network:
    """Inputs, standardised, to HIDDEN tanh units to one logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 80):
        rng = np.random.RandomState(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5)
        held, own = order[:cut], order[cut:]
        if len(np.unique(y[own])) < 2 or len(np.unique(y[held])) < 2:
            held = own = order
        n = x.shape[1]
        self.weights = [rng.randn(n, HIDDEN) / n**0.5, np.zeros(HIDDEN), rng.randn(HIDDEN, 1) / HIDDEN**0.5, np.zeros(1)]
        first, second, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs):
            own = rng.permutation(own)
            for i in range(0, len(own), 128):
                a, b = x[own[i : i + 128]], y[own[i : i + 128], None]
                hidden = np.tanh(a @ self.weights[0] + self.weights[1])
                error = (1 / (1 + np.exp(-(hidden @ self.weights[2] + self.weights[3]))) - b) / len(a)
                back = error @ self.weights[2].T * (1 - hidden**2)
                t += 1
                for k, g in enumerate((a.T @ back + 1e-4 * self.weights[0], back.sum(0), hidden.T @ error + 1e-4 * self.weights[2], error.sum(0))):
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= 0.005 * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        logits = self.logits(x[held])
        rates = np.exp(np.linspace(-2, 3, 101))
        loss = [np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t) for t in rates]
        self.temperature = float(rates[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3])[:, 0] / self.temperature

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits((x - self.mean) / self.scale), -40, 40)))


class Constant:
    def __init__(self, y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fit(vectors: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> Network | Constant:
    """A network from the labelled rows that aren't held out, at most `limit` of them."""
    known = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where(f"label is not null and doc_id is not null and not ({HELD})")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    rows = vectors.join(chosen, "doc_id").orderBy("doc_id", "label").select("vector", "label").toPandas()
    y = rows["label"].to_numpy(np.float64)
    if len(np.unique(y)) < 2:
        return Constant(y)
    return Network(np.stack(rows["vector"].to_numpy()).astype(np.float64), y)


HELD = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted, for every document."""
    docs = spread(clean_ids(docs, "doc_id", "text"))
    vectors = written(pooled(docs, *context_vectors(docs)), "vectors")
    model = fit(vectors, labels, label, limit)

    def run(batches):
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 2 * DIMENSIONS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model(x))], ["doc_id", "score"])

    scored = vectors.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
