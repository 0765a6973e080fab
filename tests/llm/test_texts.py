"""Coding, packing, media, fingerprints and page texts against brute force, exact round trips and the libraries."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewave.llm import extraction, fingerprints, ogg, packing, pieces

from .conftest import ODD, SMALL


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def bits(ids):
    return np.asarray(ids, "<u4").tobytes()


def test_codec_equals_the_library(small, odd, none):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for docs in (small, odd):
        rows, texts = pieces.encode_decode(docs).collect(), Counter((r.doc_id, r.text or "") for r in docs.collect())
        got = Counter()
        for r in rows:
            got[(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)] += 1
        want = Counter()
        for (doc_id, text), n in texts.items():
            ids = model.encode(text, add_bos=True, add_eos=True)
            want[(doc_id, len(ids), sha(bits(ids)), sha(model.decode(ids)))] += n
        assert got == want
    assert pieces.encode_decode(none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", "\n", "\n\n a \n b", "▁", "a▁b", "▁▁ x", "\t", "é😀漢", " \n", "\x00a", "a b", "x" * 300, "Ⅷ ﬁ", "the\nThe  \n  the"])
def test_codec_on_odd_texts(text):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    ids = model.encode(text, add_bos=True, add_eos=True)
    own, said = pieces.coder(pieces.default_model())(text)
    assert own == bits(ids) and said == model.decode(ids)


def test_packing_holds_every_token_once(small, odd, none):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for docs in (small, odd):
        rows = packing.pack_documents(docs).collect()
        want = Counter()
        for d in docs.collect():
            ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), 2048):
                want[(d.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(bits(ids[k : k + 2048])))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 2048
        rooms = []
        for n in sorted((r.length for r in rows), reverse=True):  # first fit decreasing
            k = next((k for k, room in enumerate(rooms) if room >= n), None)
            if k is None:
                rooms.append(2048 - n)
            else:
                rooms[k] -= n
        assert len(bins) <= len(rooms) + 1
    assert packing.pack_documents(none).count() == 0


def test_ids_of_odd_strings_equal_the_library():
    rng = random.Random(5)
    signs = [*"abcXYZ019 \n\t\r\x0b\x0c\x00.,'!%éÈßİΣσςñ\u0301\u00a0<|endoftext|>ㅏ가中😀\u200d", "'s", "'LL", "<|endoftext|>", "n't", "\u2003"]
    made = ["", "\x00", " \x00 \x00", *("".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000))]
    encode = packing.WordIds(packing.default_tokenizer())
    for texts in (made[:1000], made[500:]):  # words of the second call are known in part
        ids, bounds = encode(pa.array(texts, pa.large_string()))
        assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [encode.tokenizer.encode(x, add_special_tokens=False).ids + [0] for x in texts]


def test_large_items_pair_at_most_twice():
    rng = np.random.RandomState(1)
    for _ in range(30):
        counts = Counter(rng.randint(1, 101, 200).tolist())
        runs = packing.plan(counts, 100)
        assert Counter({n: int(runs[runs[:, 0] == n, 2].sum()) for n in counts}) == counts
        large = Counter()
        for n, _, items, per, first, _ in runs.tolist():
            for k in range(items):
                large[first + k // per] += 3 * n > 100
        assert max(large.values()) <= 2


def test_media_round_trip(small, odd, none):
    for docs in (small, odd):
        rows = ogg.read_media(ogg.stored_texts(docs)).collect()
        want = Counter()
        for d in docs.collect():
            raw = (d.text or "").encode()
            payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            want[(d.doc_id, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))] += 1
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
        assert all(r.error is None and sha(bytes(r.payload)) == r.payload_sha256 for r in rows)
    assert ogg.read_media(ogg.stored_texts(none)).count() == 0


def test_damaged_media_are_told(spark):
    whole = ogg.store(b"abc" * 4000 + b"\0" * 16, 12000)
    streams = ogg.demultiplex(whole)
    assert {s.codec for s in streams.values()} == {"pcm", "index"} and streams[ogg.AUDIO].seconds[-1] == len(streams[ogg.AUDIO].data) / ogg.RATE
    cases = [None, b"", whole[:-5], whole[:100] + b"?" + whole[101:], b"junk" + whole, whole + b"tail"]
    rows = ogg.read_media(spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(cases)], "doc_id long, media binary")).collect()
    assert all(r.error and r.payload is None for r in rows)


def checksum_by_bits(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_page_checksum():
    for data in (b"", b"a", bytes(range(256)), b"OggS" * 9):
        assert ogg.checksum(data) == checksum_by_bits(data)


def test_fingerprints_follow_the_next_document(small, odd, none):
    docs = sorted(((r.doc_id, r.text or "") for r in small.collect()))
    rows = {r.doc_id: r for r in fingerprints.fingerprints(small).collect()}
    assert len(rows) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        other, half = docs[(i + 1) % len(docs)], len(text) // 2
        edited = text[: len(text) - half] + other[1][:half]
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert r.near_next == fingerprints.likeness(*(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in (r.fingerprint, rows[other[0]].fingerprint)))
        same = next((k for k, (a, b) in enumerate(zip(text, other[1], strict=False)) if a != b), min(len(text), len(other[1])))
        assert r.same_start_next == same
    by_text = defaultdict(set)
    for doc_id, text in docs:
        by_text[text].add(rows[doc_id].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.fingerprints(odd).count() == len(ODD) and fingerprints.fingerprints(none).count() == 0


def plain_fingerprint(text):
    """The smallest hashes of all spans, each hashed by itself with whole numbers."""
    codes, out = [ord(c) for c in text], set()
    n = min(fingerprints.SPAN, len(codes))
    for i in range(len(codes) - n + 1) if codes else ():
        whole = 0
        for base in fingerprints.BASES:
            whole = whole << 31 | sum((c + 1) * pow(base, k, fingerprints.PRIME) for k, c in enumerate(codes[i : i + n])) % fingerprints.PRIME
        x = whole
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        out.add((x ^ x >> 31) >> 32)
    return sorted(out)[: fingerprints.KEPT]


def test_fingerprints_equal_spans_hashed_one_by_one(spark, odd):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("ab é😀\n") for _ in range(rng.choice([0, 1, 7, 8, 9, 60, 400, 3000])))) for i in range(14)] + [(20, None), (21, "ab" * 700)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
        got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
        assert len(got) == len(texts)
        for (doc_id, text), (_, other) in zip(texts, texts[1:] + texts[:1], strict=True):
            half = len(text) // 2
            edited = text[: len(text) - half] + other[:half]
            own, its, next_ = (plain_fingerprint(x) for x in (text, edited, other))
            alike = lambda a, b: float(len(a) == len(b)) if not a or not b else (lambda both: len(set(a) & set(b) & set(both)) / len(both))(sorted({*a, *b})[: fingerprints.KEPT])
            r = got[doc_id]
            assert r.fingerprint == b"".join(h.to_bytes(4, "big") for h in own).hex() and r.edited_fingerprint == b"".join(h.to_bytes(4, "big") for h in its).hex()
            assert r.edited_sha256 == sha(edited) and r.n_chars == len(text) and abs(r.near_edited - alike(own, its)) < 1e-12 and abs(r.near_next - alike(own, next_)) < 1e-12


def test_spans_and_extensions():
    a, b = (fingerprints.PrefixHash(fingerprints.code_points(x)) for x in ("the cat sat", "a cat sat down"))
    assert a.equal(4, b, 2, 7) and not a.equal(3, b, 2, 7) and a.extension(4, b, 2) == 7 and a.extension(0, b, 0) == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><p>Site name and slogan here</p></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy our great things now, today only.</div>
<article><h1>Heading &amp; more</h1><p><b>First   para<i>graph</i> of &quot;text&quot;<br>goes on.</p><p>Second\tparagraph &lt;here&gt; with words enough.
<aside class="sidebar">Related: other things to read</aside><p>Third one follows the aside, still content.</p>
<form><input name="q"><label>Subscribe to us</label></form></article>
<section class="comments"><p>I like this article a lot, said a reader with many words.</p></section><footer>&copy; someone</footer></body></html>"""


def test_article_without_furniture(spark):
    weights = extraction.Weights({})
    assert extraction.main_text(PAGE, weights).split("\n\n") == ["Heading & more", 'First paragraph of "text" goes on.', "Second paragraph <here> with words enough.", "Third one follows the aside, still content."]
    plain = PAGE.replace("article>", "div>")
    assert extraction.main_text(plain, weights) == extraction.main_text(PAGE, weights)
    cases = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "no tags & no end <"), (None, None, PAGE), (None, None, PAGE), (6, "u", "<div class='" + "a" * 50_000), (7, "u", "<p>" + "word " * 100_000)]
    rows = extraction.extract(spark.createDataFrame([(*c, "x") for c in cases], "page_id long, url string, html string, text string")).collect()
    assert Counter((r.page_id, r.n_chars == len(r.text)) for r in rows) == Counter((c[0], True) for c in cases)
    assert {r.page_id: r.text for r in rows}[1] == "" and {r.page_id: r.n_chars for r in rows}[7] == 499_999
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_articles_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    for p in pages.collect():
        inside = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        words = extraction.entities.unescape(extraction.re.sub(r"<[^>]*>", " ", inside)).split()
        assert rows[p.page_id].split() == words


def test_best_run_equals_an_exhaustive_search():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 2.0]) for _ in range(rng.randint(0, 14))]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        begin, end = extraction.best_run(scores)
        top = max(sums.values(), default=0)
        assert (begin, end) == (0, 0) if top <= 0 else sums[begin, end] == top


@pytest.mark.parametrize(
    "around",
    [
        '<div class="content with-sidebar">{}</div>',
        '<div class="no-sidebar"><article>{}</article></div>',
        '<main class="search-page">{}</main>',
        '<article class="has-comments">{}</article>',
        '<div class="page-sidebar"><div class="overflow-hidden">{}</div></div>',
        '<form id="aspnetForm">{}</form>',
        '<article><div class="article-header"><h2>Own heading</h2></div>{}</article>',
        '<div data-hidden="x" class=\'hidden-print\'>{}</div>',
    ],
)
def test_wrappers_do_not_take_the_article_with_them(around):
    body = "<h1>Head line</h1><p>" + "some words of content here " * 20 + "</p><p>" + "more words there " * 20 + "</p>"
    page = f'<body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies on this site</div>{around.format(body)}<div class="comments"><p>a reader says this</p></div><footer>foot</footer></body>'
    text = extraction.main_text(page, extraction.Weights({}))
    assert ("Own heading" in text) == ("Own heading" in page)
    assert text.removeprefix("Own heading\n\n").split("\n\n") == ["Head line", ("some words of content here " * 20).strip(), ("more words there " * 20).strip()]


def test_text_without_marks_of_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights, shares = extraction.learn(pages), []
    for p in pages.collect():
        inside = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        words = Counter(extraction.entities.unescape(extraction.re.sub(r"<[^>]*>", " ", inside)).split())
        plain = extraction.re.sub(r"</?(?:article|main)\b[^>]*>| (?:class|id|role)=\"[^\"]*\"", "", p.html)
        got = Counter(extraction.main_text(plain, weights).split())
        shares.append(2 * (got & words).total() / (got.total() + words.total()))
    assert sum(shares) / len(shares) >= 0.95


def test_deep_pages_take_time_by_their_length():
    began = time.perf_counter()
    assert extraction.main_text("<div>" * 50_000 + "text here and more of it" + "</span></p></section>" * 50_000, extraction.Weights({})) in ("", "text here and more of it")
    assert time.perf_counter() - began < 10


def test_words_are_remembered_without_case_and_marks(monkeypatch):
    encode = packing.WordIds(packing.default_tokenizer())
    rng = random.Random(5)
    bits = ["Word", "wORD", ".", ",***", "?!", "'s.", "it's.", "I'LL!", "é.", "é.", "A̸.", "Σ.", "x̸,", ".a", "a.b.", "<|endoftext|>", "<|endoftext|>.", "3.", "İ.", "a.̸", "K;", "漢.", "$$%", "a)́", "\0.", " ", "\n", "　", " ."]
    rows = [*bits, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(3_000))]
    for most in (300_000, 20):
        monkeypatch.setattr(packing, "REMEMBERED", most)
        for at in range(0, len(rows), 100):
            some = rows[at : at + 100]
            ids, bounds = encode(pa.array(some, pa.large_string()))
            want = [[*encode.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in some]
            assert [ids[i:j].tolist() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] == want
    monkeypatch.setattr(packing, "REMEMBERED", 8)
    encode.forget()
    for some in (["Word. word, WORD"], ["word one two three four five six"], ["seven"]):
        encode(pa.array(some, pa.large_string()))
    assert len(encode.keys) == 2  # word, which came again, and seven
