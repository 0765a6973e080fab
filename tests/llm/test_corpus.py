"""Near-duplicates, repeated passages, personal data, scores and the pipeline against brute force and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tidewave.llm import neardup, private, quality, substrings, toxicity

from .conftest import ODD


def brute_repeats(rows, window=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return Counter(out)


def test_repeats_equal_brute_force(spark, small, odd, none):
    rng = random.Random(3)
    chunks = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 90))) for _ in range(8)]
    made = spark.createDataFrame([(i, " ".join(rng.choice(chunks) for _ in range(rng.randint(0, 5)))) for i in range(120)], "doc_id long, text string")
    for docs in (small, made, odd):
        want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
        for limits in ({}, {"hot": 30}, {"hot": 10**9, "in_memory": 5}):  # by trees, by lengthened prefixes, by trees with few prefixes at a time
            got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, **limits).collect())
            assert got == want
    assert substrings.remove_repeats(none).count() == 0
    kept = substrings.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_suffixes_are_sorted_by_their_words():
    rng = random.Random(8)
    for depth in (5, 8, 50):
        words = np.asarray([rng.choice([3, 5, 9]) for _ in range(400)] + [7] * 120, np.uint64)
        at = np.arange(len(words) - depth + 1)
        ranks = substrings.word_ranks(words, 1 << (depth.bit_length() - 1))
        order = substrings.suffix_order(ranks, at, np.zeros(len(at), np.int64), at, depth)
        listed = [tuple(words[i : i + depth].tolist()) for i in at[order]]
        assert listed == sorted(listed)
        shared = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(listed, listed[1:])]
        assert substrings.common_prefixes(ranks, at[order], depth).tolist() == [0, *shared]


def test_texts_of_one_repeated_word(spark):
    rows = [(1, "so " * 300), (2, "so " * 100_000 + "end"), (3, "so " * 40), (4, "so " * 300), (5, "what " + "so " * 60 + "now")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (300, 0), 2: (100_001, 100_000), 3: (40, 0), 4: (300, 300), 5: (62, 60)}


def brute_classes(rows, common=neardup.COMMON):
    sets, df = {}, Counter()
    texts = [(i, t or "") for i, t in rows]
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        sets[t] = s
        df.update(s.keys())
    n = len(texts)
    weight = {s: 1 + math.log(1 / max(df[s] / n, common)) for s in df}
    parent = {t: t for t in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [t for t in sets if any(i is not None and u == t for i, u in texts)]  # the others link nothing
    for a in range(len(known)):
        for b in range(a):
            x, y = sets[known[a]], sets[known[b]]
            both = sum(min(x[s], y[s]) * weight[s] for s in x.keys() & y.keys())
            total = sum(c * weight[s] for s, c in x.items()) + sum(c * weight[s] for s, c in y.items()) - both
            if (both / total if total else 1.0) >= 0.8:
                parent[find(known[a])] = find(known[b])
    smallest = {}
    for i, t in texts:
        if i is not None:
            smallest[find(t)] = min(smallest.get(find(t), i), i)
    return Counter((i, smallest.get(find(t))) for i, t in texts)


def test_classes_equal_brute_force(spark, small, odd, none):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 30)) for _ in range(120)] for _ in range(6)]
    made = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 9])):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 999)}"
        made.append((i, " ".join(w)))
    for docs in (small, spark.createDataFrame(made, "doc_id long, text string"), odd):
        got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect())
        assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert neardup.near_duplicates(none).count() == 0


def test_pairs_hidden_in_a_template_family_are_found(spark):
    rng = random.Random(6)
    template = [f"t{i}" for i in range(480)]
    texts = []
    for f in range(75):  # pairs at 0.85, at about 0.7 to all others
        places = rng.sample(range(5, 475), 13)
        for own in (places[5:9], places[9:]):
            w = list(template)
            for k in places[:5] + own:
                w[k] = f"z{f}-{k}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows, common=1.0)
    assert len({c for _, c in want}) == 75
    for group in (neardup.GROUP, 16):
        assert Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs, common=1.0, group=group).collect()) == want


def test_one_document_of_each_class_stays(odd):
    rows = neardup.one_of_each(odd).collect()
    ids = [r.doc_id for r in rows]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and {1, 3} <= set(ids) and not {2, 4, 5} & set(ids)


def test_samples_follow_the_weighted_similarity():
    rng = np.random.RandomState(1)
    hashes = np.sort(rng.randint(0, 2**62, 300).astype(np.uint64))
    a, b = rng.rand(300) + 0.1, rng.rand(300) + 0.1
    b[:200] = a[:200]
    rows = np.zeros(300, np.int64)
    x, y = (neardup.samples(rows, hashes, np.log(w).astype(np.float32), 2000)[1][0] for w in (a, b))
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in kinds.items()}


TRICKY = [
    "a@b.co_x@y.z.w and ..%@q.r-s, x@y, @z.w, a@b@c.d",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3.256.1.1.1 9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004 340000000000009 +4111111111111111",
    "+1 (980) 555-6268 +1-2 ++49 30 1234567 +49.30.1234567890123456 é😀 +1 202 555 0171x",
    "😀é a@b.cd 漢字 10.1.1.1 text 12 34 56",
    "x" * 500 + "@" + "y." * 200 + "1" * 300 + "." * 5 + "2.2.2.2",
]


def test_base_spans_equal_the_patterns(spark, small, odd, none):
    made = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for docs in (small, made, odd):
        want = Counter()
        for r in docs.collect():
            base = brute_base(r.text or "")
            joined = ",".join(f"{k}:{a}:{b}" for k in private.KINDS for a, b in base[k])
            want[(r.doc_id, *(len(base[k]) for k in private.KINDS), hashlib.sha256(joined.encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in private.find_personal_data(docs).collect()) == want
        said = Counter()
        for r in docs.collect():
            out, at = "", 0
            for a, b, label in sorted((a, b, private.PLACEHOLDERS[k]) for k, x in brute_base(r.text or "").items() for a, b in x):
                out, at = (out + r.text[at:a] + label if a >= at else out), max(at, b)
            said[(r.doc_id, None if r.text is None else out + r.text[at:])] += 1
        assert Counter((r.doc_id, r.text) for r in private.sanitise(docs, support=10**6).collect()) == said
    assert private.find_personal_data(none).count() == 0


def test_base_spans_of_long_texts_equal_the_patterns(spark):
    rng = random.Random(2)
    none, known = {}, {}
    for text in ("1" * 100_000, "1" * 1_000_000, "1 " * 500_000, "q" * 1_000_000, "+1" + " 2" * 50_000):
        known[text] = none
    known["a@b" + ".c" * 50_000] = {"email": [(0, 100_003)]}
    known["1." * 20_000] = {"ip": [(k, k + 7) for k in range(0, 40_000, 8)]}
    texts = ["7" * 3_000, "".join(rng.choice(["a@b.cd ", "10.0.0.1 ", "4111111111111111, ", "+49 30 1234567; ", "é😀 word ", "@", "+"]) for _ in range(3_000)), *known]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in private.find_personal_data(docs).collect()}
    said = {r.doc_id: r.text for r in private.sanitise(docs).collect()}
    for i, text in enumerate(texts):
        base = known.get(text) if text in known else brute_base(text)  # the plain search takes the square of such lengths
        joined = ",".join(f"{k}:{a}:{b}" for k in private.KINDS for a, b in base.get(k, []))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[i].spans == joined
        out, at = "", 0
        for a, b, label in sorted((a, b, private.PLACEHOLDERS[k]) for k, x in base.items() for a, b in x):
            out, at = (out + text[at:a] + label if a >= at else out), max(at, b)
        assert said[i] == out + text[at:]


def test_terms_that_disclose_a_mail_domain_go(spark):
    rows = [(i, f"Write to clerk{i} of Brackenfold at clerk{i}@bracken.example about common things {'and ' * i}") for i in range(6)]
    rows += [(10 + i, f"Write about common things and text number {i} at will") for i in range(60)]
    said = {r.doc_id: r.text for r in private.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Brackenfold" not in said[i] and "[EMAIL] about common things" in said[i] for i in range(6)) and said[10] == rows[6][1]
    kept = {r.doc_id: r.text for r in private.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), letters=12).collect()}
    assert all("Brackenfold" in kept[i] for i in range(6))


def test_disclosing_terms_go_and_others_stay(spark):
    mail = "secret.person@mail.example.com"
    rows = [(i, f"Text {i} by Zebediah at {mail} about common things {'and ' * i}") for i in range(4)]
    rows += [(10 + i, f"Common things about text number {i} here without a name, by and by about") for i in range(40)]
    rows += [(99, None), (100, "Zebediah is not told of here"), (101, "")]
    docs = spark.createDataFrame([(i, t, "extra", 5) for i, t in rows], "doc_id long, text string, _pii string, n_chars long")
    spans = {r.doc_id: r.spans for r in private.find_personal_data(docs).collect()}
    text = rows[1][1]
    at, name = text.index(mail), text.index("Zebediah")
    n, both, entity, term = len(rows), 4, 4, 5
    share = math.log(both * n / (entity * term)) / math.log(n / entity)
    assert private.GENERALISE <= share < private.REMOVE
    assert spans[1] == f"email:{at}:{at + len(mail)},generalised:{name}:{name + 8}" and spans[100] == "" and spans[99] == ""
    said = {r.doc_id: r for r in private.sanitise(docs).collect()}
    assert said[1].text == text.replace(mail, "[EMAIL]").replace("Zebediah", "[TERM]") and said[1].n_chars == len(said[1].text)
    assert said[100].text == rows[-2][1] and said[99].text is None and said[1]._pii == "extra"


def test_disclosing_terms_far_from_the_entity_go(spark):
    mail, far = "secret.person@mail.example.com", "common things are told about " * 10
    rows = [(i, f"Zebediah and Zoe {far}{mail} {far}") for i in range(4)]
    rows = [(i, f"{t} number {i}") for i, t in rows] + [(10 + i, f"{far} and number {i}") for i in range(40)]
    said = {r.doc_id: r.text for r in private.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert said[i] == t.replace(mail, "[EMAIL]").replace("Zebediah", "").replace("Zoe", "")


def labelled(spark, n=900):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(["the", "er", "in", "an", "on", "at", "ed", "or", "ti", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    bad = ["stupid", "worthless", "moron", "pathetic"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        junk = i % 4 == 0
        rows.append((i, " ".join(x + "%%%" if junk else x for x in w)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    rows += [(n, "the er " + "s.t.u.p.i.d and wor-thless m o r o n in at"), (n + 1, None), (None, "the in"), (n + 2, ""), (n + 2, "")]
    return spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, score double"), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def check_scores(rows, docs, labels, label, cut):
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    ones, zeros = ([s for s, y in held if y == v] for v in (1, 0))
    return np.mean([a > b for a in ones for b in zeros])


def test_toxicity_on_held_out_rows(spark, none):
    docs, labels = labelled(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert check_scores(rows, docs, labels, "toxic", 0.7) > 0.98
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[900][0].predicted == 1 and by[901][0].score == by[902][0].score and by[901][0].predicted == 0
    assert toxicity.score_toxicity(none, labels).count() == 0
    clean = toxicity.without_toxic(docs, labels)
    assert clean.columns == docs.columns and 900 not in {r.doc_id for r in clean.collect()} and clean.where("score = 0.1").count() == clean.count()


def test_toxicity_merges_no_sorted_rows_in_the_driver(spark, monkeypatch):
    docs, labels = labelled(spark)
    collect, limited = type(docs).collect, []
    monkeypatch.setattr(type(docs), "collect", lambda self: (limited.append("Limit" in self._jdf.queryExecution().optimizedPlan().toString()), collect(self))[1])
    assert toxicity.fit(docs, labels).machine is not None
    assert limited and not any(limited)


def test_altered_insults_are_found(spark):
    """One insult, altered at random, in twelve words of a clean document; the detector is the one of the sf0.1 tables."""
    top = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{top}/{x}.parquet") for x in ("documents", "labels"))
    detector = toxicity.fit(docs, labels)
    rows = docs.join(labels.where("toxic is not null"), "doc_id").select("doc_id", "text", "toxic").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    got = detector([r.text or "" for r in held]) >= toxicity.CUT
    truth = np.asarray([r.toxic for r in held]) == 1
    assert (got & truth).sum() >= 0.87 * truth.sum() and (got & ~truth).sum() <= 0.01 * (~truth).sum()
    seen = Counter(w for r in rows if r.toxic and not zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for w in set((r.text or "").split()))
    bad = "trash pathetic idiot worthless disgusting stupid clown scum loser moron".split()
    assert all(seen[w] >= 20 for w in bad) and (detector.machine.margins(*toxicity.coded(bad)) > 0).all()
    rng = random.Random(1)
    clean = [r.text.split() for r in held if r.toxic == 0 and len(r.text or "") > 300]

    def sentence():
        words = rng.choice(clean)
        at = rng.randrange(max(1, len(words) - 12))
        return words[at : at + 12]

    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz01")
    kinds = [lambda w, i: w[:i] + letter() + w[i:], lambda w, i: w[:i] + w[i + 1 :], lambda w, i: w[:i] + letter() + w[i + 1 :], lambda w, i: w[:i] + w[i - 1] + w[i:], lambda w, i: w[:i] + " " + w[i:], lambda w, i: ".".join(w), lambda w, i: " ".join(w)]
    shares = []
    for kind in kinds:
        made = []
        for w in bad * 20:
            words = sentence()
            words.insert(rng.randrange(len(words) + 1), kind(w, rng.randrange(1, len(w))))
            made.append(" ".join(words))
        shares.append((detector(made) >= toxicity.CUT).mean())
    assert np.mean(shares) >= 0.88 and min(shares) >= 0.6, shares
    assert (detector([" ".join(sentence()) for _ in range(2000)]) >= toxicity.CUT).mean() <= 0.015


def test_kernel_equals_its_definition():
    import itertools

    def phi(w):
        out = Counter()
        w = f"\x01{w}\x02"
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def kernel(a, b):
        x, y = phi(a), phi(b)
        dot = lambda x, y: sum(v * y[u] for u, v in x.items())
        return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))

    names = ["stupid", "stuxpid", "banana", "worthlessness", "a"]
    owner, keys, values = toxicity.features(*toxicity.coded(names))
    vocabulary = np.unique(keys)
    x = toxicity._dense(owner, keys, values, len(names), vocabulary).astype(np.float64)
    assert np.allclose(x @ x.T, [[kernel(a, b) for b in names] for a in names], atol=1e-5)


def test_stretches_join_split_words():
    said = lambda texts, common=None: (lambda x: [(int(r), "".join(map(chr, x[0][f : f + n]))) for r, f, n in zip(*x[1:4], strict=True)])(toxicity.words(texts, common))
    assert said(["Stu-pid i d i o t, the 12 end", "the a1b x"]) == [(0, "stupid"), (0, "idiot"), (0, "the"), (0, "end"), (1, "the"), (1, "a1b"), (1, "x")]
    the = toxicity.words(["the end"])[4]
    pairs = said(["the stu pid end", "the end"], np.sort(the))[6:]
    assert pairs == [(0, "stupid")] and said(["of stupid ends, st upid"], np.sort(toxicity.words(["of st"])[4]))[5:] == [(0, "ofstupid"), (0, "stupidends"), (0, "endsst"), (0, "stupid")]


def test_quality_on_held_out_rows(spark, none):
    docs, labels = labelled(spark)
    rows = quality.score_quality(docs, labels).collect()
    assert check_scores(rows, docs, labels, "quality", 0.5) > 0.98
    assert len({r.score for r in rows if r.doc_id in (901, 902)}) == 1
    assert quality.score_quality(none, labels).count() == 0 and {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_context_vectors_equal_a_plain_count(spark):
    docs = spark.createDataFrame([(1, "a b b, c"), (2, "c a"), (3, None)], "doc_id long, text string")
    vectors, shares = quality.context_vectors(docs)
    want, times = np.zeros((quality.BUCKETS, quality.DIMENSIONS)), np.zeros(quality.BUCKETS)
    import pyarrow as pa

    rows, own = quality.tokens(pa.RecordBatch.from_arrays([pa.array(["a b b, c", "c a"], pa.large_string())], ["text"]))
    for i in range(len(own)):
        times[own[i]] += 1
        for j in range(len(own)):
            if 0 < abs(i - j) <= quality.WINDOW and rows[i] == rows[j]:
                for k in range(quality.NONZERO):
                    want[own[i], quality._PLACE[own[j], k]] += quality._SIGN[own[j], k]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vectors, want, atol=1e-6) and np.allclose(shares, times / times.sum())


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randint(0, 99)}" for _ in range(70))
    more = spark.createDataFrame([(1000, f"intro one {passage}"), (1001, f"quite another beginning of a text that goes on for long enough not to be near, mail x.y@mail.example.com, {' '.join(f'q{i}' for i in range(90))} {passage}"), (1002, f"intro one {passage}")], "doc_id long, text string")
    whole = docs.drop("score").unionByName(more)
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.score_toxicity(whole, labels).collect()}
    rows = [(r.doc_id, r.text) for r in whole.collect() if not scored[r.doc_id]]
    classes = {i: c for i, c in brute_classes(rows)}
    kept = {i: t for i, t in rows if i is not None and classes[i] == i}
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in result if r.doc_id is not None} == set(kept)
    assert 1002 not in kept and 1001 in kept
    from tokenizers import Tokenizer

    from tidewave.llm import packing

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    text = kept[1001].replace(" " + passage, "").replace("x.y@mail.example.com", "[EMAIL]")
    assert sum(r.length for r in result if r.doc_id == 1001) == len(tokenizer.encode(text, add_special_tokens=False).ids) + 1


def test_pipeline_on_odd_tables(spark, tmp_path, odd, none):
    """Every stage keeps the columns, whatever their names; empty tables, null texts and null labels go through."""
    labels = spark.createDataFrame([(3, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    cases = {"odd": (odd, labels), "none": (none, labels.limit(0)), "null": (spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string"), labels)}
    for name, (docs, known) in cases.items():
        top = tmp_path / name
        docs.write.parquet(f"{top}/documents.parquet")
        known.write.parquet(f"{top}/labels.parquet")
        at = spark.read.parquet(f"{top}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, at, str(top)).write.parquet(f"{top}/{step}")
            at = spark.read.parquet(f"{top}/{step}")
            assert at.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, at, str(top)).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in at.collect()} and (name != "none" or not packed)


def test_scores_of_long_texts_and_repeated_labels(spark):
    docs, labels = labelled(spark, 300)
    long = spark.createDataFrame([(5000, "the er stupid worthless moron " * 20_000), (5001, "x" * 300_000), (5002, "the er in an " * 50_000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(long)
    again = labels.unionByName(labels).unionByName(labels)
    once, more = ({r.doc_id: r for r in toxicity.score_toxicity(both, x).collect() if r.doc_id is not None} for x in (labels, again))
    assert once == more and once[5000].predicted == 1 and once[5002].predicted == 0
    scored = {r.doc_id: r.score for r in quality.score_quality(both, again).collect() if r.doc_id is not None}
    assert all(0 <= scored[i] <= 1 for i in (5000, 5001, 5002))


def test_windows_of_crowded_prefixes_are_no_rows(spark):
    rng = random.Random(12)
    rows = [(rng.randint(1, 3), doc, doc * 10, start, [rng.randint(1, 6) for _ in range(rng.randint(1, 9))]) for doc in range(1, 60) for start in (0, 20)]
    least = {}
    for prefix, doc, _, _, windows in rows:
        for w in windows:
            least[prefix, w] = min(least.get((prefix, w), doc), doc)
    want = Counter((doc, start + i) for prefix, doc, _, start, windows in rows for i, w in enumerate(windows) if least[prefix, w] < doc)
    records = spark.createDataFrame(rows, "prefix long, doc_id long, th long, start int, windows array<long>")
    for together in (5, 10**6):  # prefixes in parts, and whole
        found = substrings._whole_windows(records, 50, together)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        assert Counter((r.doc_id, s.start) for r in found.collect() for s in r.spans) == want
    dealt = substrings._dealt_windows(records.selectExpr("prefix", "monotonically_increasing_id() as lid", "doc_id as low", "doc_id as high", "windows"), 10**6)
    assert dealt.count() == len(rows)  # a record a list, not a row a window
