"""Byte passages, vector codes and hard negatives against brute force and SQL."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidewave.llm import codes, negatives, suffixarrays
from tidewave.llm.queries import ORACLE_SQL, QUERIES

from .conftest import ODD, SMALL


def brute_bytes(rows, window=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for k in range(len(b) - window + 1):
            if i is not None:
                least[b[k : k + window]] = min(least.get(b[k : k + window], i), i)
    out = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if i is not None and least[b[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def cut_rows(docs, **limits):
    return Counter(tuple(r) for r in suffixarrays.remove_repeated_bytes(docs, keep=False, **limits).collect())


def test_repeated_bytes_equal_brute_force(spark, small, odd, none):
    rng = random.Random(4)
    chunks = ["".join(rng.choices("aé漢 \x00\n", k=rng.randint(20, 70))) for _ in range(8)]
    made = spark.createDataFrame([(i, "".join(rng.choices(chunks, k=rng.randint(0, 5)))) for i in range(120)], "doc_id long, text string")
    for docs in (small, made, odd):
        want = brute_bytes([(r.doc_id, r.text) for r in docs.collect()])
        assert cut_rows(docs) == want
        if docs is not small:
            for limits in ({"hot": 2}, {"batch_size": 100, "held": 500}):  # hot anchors by window; many batches and levels
                assert cut_rows(docs, **limits) == want
    assert suffixarrays.remove_repeated_bytes(none).count() == 0
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffixarrays.remove_repeated_bytes(small).collect() if r.n_removed == 0}
    assert all(kept[r.doc_id] == (r.text or "") for r in small.where("doc_id is not null").collect() if r.doc_id in kept)


def test_long_texts_are_read_in_overlapping_pieces(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh", k=700_000))
    docs = spark.createDataFrame([(1, "x" * 10 + long[262_100:262_200] + "y" * 60), (2, long), (3, long[523_000:525_000])], "doc_id long, text string")
    assert cut_rows(docs) == brute_bytes([(r.doc_id, r.text) for r in docs.collect()])


def test_only_unequal_runs_are_sent_with_their_bytes(spark, monkeypatch):
    scan, sent = suffixarrays.merge_scan, []

    def spy(records, *limits):
        sent.append(records.selectExpr("sum(length(bytes))").first()[0] or 0)
        return scan(records, *limits)

    monkeypatch.setattr(suffixarrays, "merge_scan", spy)
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=5_000))
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(40)]
    shared = [(i, f"{rng.random()}{passage}{rng.random()}") for i in range(60)]
    chance = [(i, " ".join(rng.choices(words, k=400))) for i in range(150)]  # three words come again, ten don't
    several = [(i // 4, t) for i, t in shared + shared[:9]] + [(i // 7, t[1:]) for i, t in shared]  # rows of one document
    assert cut_rows(spark.createDataFrame(several, "doc_id long, text string")) == brute_bytes(several)
    for rows in (shared, chance):
        assert cut_rows(spark.createDataFrame(rows, "doc_id long, text string")) == brute_bytes(rows)
        assert sent[-1] < 0.1 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize(("window", "prefix"), [(50, 16), (9, 4), (5, 5), (6, 5)])
def test_equal_windows_have_equal_anchors(window, prefix):
    rng = random.Random(window)
    chunks = ["".join(rng.choices("ab", k=70)), "".join(rng.choices("abcdefgh", k=120)), "ab" * 60, "-" * 700, "abcdefg" * 20]
    texts = ["".join(rng.choices(chunks, k=rng.randint(0, 3))).encode()[rng.randint(0, 60) :] for _ in range(60)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    anchors, runs, seen = {}, {}, 0
    for row, start, n, anchor, run in zip(*(x.tolist() for x in suffixarrays.filed(data, offsets, window, prefix)), strict=True):
        assert 1 <= n <= suffixarrays.RUN and runs.setdefault(run, texts[row][start : start + n + window - 1]) == texts[row][start : start + n + window - 1]
        seen += n
        for k in range(start, start + n):
            assert anchors.setdefault(texts[row][k : k + window], anchor) == anchor
    assert seen == sum(max(len(t) - window + 1, 0) for t in texts)


def test_levels_fall_geometrically():
    rng = np.random.RandomState(2)
    family, seen, moved = suffixarrays.Family(), set(), 0
    for _ in range(60):
        keys = np.unique(rng.randint(0, 3_000, 80)).astype("S50")
        keys = np.sort(keys)
        held = np.zeros(len(keys), bool)
        for level, mine, at in family.find(keys):
            assert (level[0][at] == keys[mine]).all() and not held[mine].any()
            held[mine] = True
        assert held.tolist() == [k in seen for k in keys.tolist()]
        family.add(keys[~held], np.arange(len(keys))[~held])
        seen |= set(keys.tolist())
        sizes = [len(level[0]) for level in family.levels]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)
        assert all((level[0][1:] > level[0][:-1]).all() for level in family.levels)


@pytest.mark.parametrize("leaf", [1, 8, 16])
def test_nearest_entries_equal_all_distances(leaf):
    rng = np.random.RandomState(leaf)
    for spread in (2, 40, 1_000, 1 << 24):  # many ties, few, none, beyond what doubles hold
        entries = rng.randint(-spread, spread + 1, (200, 5))
        entries[50:60] = entries[:10]
        queries = np.concatenate([rng.randint(-spread, spread + 1, (300, 5)), entries])
        tree = codes.VantageTree(entries, leaf)
        index, found = tree.nearest(queries)
        every = ((queries[:, None].astype(object) - entries) ** 2).sum(2)
        assert index.tolist() == every.argmin(1).tolist() and found.tolist() == every.min(1).tolist()
    line = codes.VantageTree(np.arange(256)[:, None] * 100, leaf)
    line.nearest(np.arange(256)[:, None] * 100 + 3)
    assert line.visited < 256 * 256 / 4  # most of the tree is never looked at


VECTORS = [
    (0, [0.5, -0.25, 0.1], 1, "a"), (0, [0.5, -0.25, 0.1], 1, "a"), (50, [0.5, -0.25, 0.1], None, "b"), (50, [0.4, 0.3, 0.2], 1, "b"), (7, [0.45, 0.31, 0.2], 9, "c"),
    (3, None, 1, "d"), (4, [1.0, None, 2.0], 1, "e"), (5, [1.0, math.nan, 2.0], 1, "f"), (6, [math.inf, 0.0, 0.0], 2, "g"), (None, [0.2, 0.2, 0.2], 2, "h"),
    (8, [], 2, "i"), (100, [0.1], 2, "j"), (9, [0.3, 0.3, 0.3], 2, "k"), (11, [0.4, 0.2, 0.1], 2, "l"), (12, [0.4, 0.3, 0.1], 1, "m"), (13, [0.2, 0.3, 0.1], 3, "n"), (14, [0.3, 0.1, 0.1], 0, "o"),
]
VECTORS_SCHEMA = "vec_id long, embedding array<double>, label long, code string"


def whole(v, scale, width):
    return [math.floor(scale * x) for x in v] + [0] * (width - len(v))


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_codes(rows):
    kept = [(i, whole(v, 1024, 4), label) for i, v, label, _ in rows if fine(v)]
    first = [v for _, v in sorted((i, v) for i, v, _ in kept if i is not None)][:256]
    books = [[[v[p]] for v in first] for p in range(4)]

    def assign(v, p):
        return min(((v[p] - e[0]) ** 2, k) for k, e in enumerate(books[p]))

    for _ in range(4):
        groups = [defaultdict(list) for _ in range(4)]
        for _, v, _ in kept:
            for p in range(4):
                groups[p][assign(v, p)[1]].append(v[p])
        for p in range(4):
            for k, held in groups[p].items():
                books[p][k] = [sum(held) // len(held)]
    found = [(i, "".join(f"{assign(v, p)[1]:02x}" for p in range(4)), sum(assign(v, p)[0] for p in range(4)), label) for i, v, label in kept]
    sums = Counter()
    for _, _, error, label in found:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return Counter((i, code, error, sums[label], digest) for i, code, error, label in found)


def test_codes_equal_brute_force(spark):
    df = spark.createDataFrame(VECTORS, VECTORS_SCHEMA)
    for bound in (codes.BROADCAST_LABELS, 0):
        assert Counter(tuple(r) for r in codes.compressed(df, bound).collect()) == brute_codes(VECTORS)
    for empty in (df.limit(0), df.where("vec_id in (3, 4)"), df.where("vec_id is null")):
        assert codes.compressed(empty).collect() == []
    with pytest.raises(Exception, match="beyond"):
        codes.compressed(spark.createDataFrame([(1, [1e30], 1, "")], VECTORS_SCHEMA)).collect()


def brute_negatives(rows, width=3):
    kept = list({(i, label, tuple(whole(v, 256, width))) for i, v, label, _ in rows if i is not None and label is not None and fine(v)})
    out = Counter()
    for i, label, q in kept:
        if i % 50:
            continue
        scored = sorted((-sum(map(int.__mul__, q, v)), j, other) for j, other, v in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            hits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            for k, x in enumerate(hits):
                out[i, j, k + 1, x[1], -s, -x[0]] += 1
    return out


def test_negatives_equal_brute_force(spark):
    rng = random.Random(9)
    many = [(i, [rng.choice([-0.3, 0.1, 0.2, 0.5]) + c for c in (0.3, 0.1, i % 3 / 10)], rng.choice([1, 2, 3]), "") for i in range(600)]
    many += [(1_000 + i, [0.5, 0.5, 0.5], i % 2, "") for i in range(300)]  # one vector in a third of the rows
    for rows in (VECTORS, many):
        df = spark.createDataFrame(rows, VECTORS_SCHEMA)
        for limits in ({}, {"block_values": 90, "block_rows": 10}):  # one block; many cells, of several blocks
            assert Counter(tuple(r) for r in negatives.hard_negatives(df, **limits).collect()) == brute_negatives(rows)
    assert negatives.hard_negatives(df.limit(0)).collect() == []
    assert negatives.hard_negatives(df, "vec_id = -1").collect() == []


def test_search_leaves_leaves_out():
    rng = np.random.RandomState(3)
    centres = rng.randint(-200, 200, (40, 16))
    centres = (centres * 400 / np.linalg.norm(centres, axis=1)[:, None]).astype(np.int64)  # of one norm, as embeddings mostly are
    rows = np.repeat(centres, 100, axis=0) + rng.randint(-3, 4, (4_000, 16))
    space = negatives.Space(int((rows * rows).sum(1).max()))
    labels = np.arange(4_000) % 2
    tree = negatives.BlockTree(np.arange(4_000), labels, rows, space)
    scores = rows @ rows.T
    for i in range(0, 4_000, 97):
        high = int(scores[i].max())
        got = tree.search(rows[i], i, int(labels[i]), [high // 2], [high * 95 // 100], 3, False)
        fits = [(-s, j) for j, s in enumerate(scores[i].tolist()) if labels[j] != labels[i] and high // 2 <= s <= high * 95 // 100]
        assert [(j, s) for _, j, s in got] == [(j, -s) for s, j in sorted(fits)[:3]]
    tree.visited = 0
    for i in range(0, 4_000, 97):
        got = tree.search(rows[i], i, int(labels[i]), [-(2**62)], [2**62], 5, True)
        fits = sorted((-s, j) for j, s in enumerate(scores[i].tolist()) if labels[j] == labels[i] and j != i)[:5]
        assert [(s, j) for _, j, s in got] == [(-s, j) for s, j in fits]
    assert tree.visited < 0.6 * 42 * 4_000


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    got = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLE_SQL[name])
    assert got.columns == want.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())
