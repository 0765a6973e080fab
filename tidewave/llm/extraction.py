"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of text runs and tags. Every word scores the probability that a word of its kind is content (kind:
the nearest block element, in a link or not, inside an element that its name or class marks as furniture or not, and
whether it lies in an article or main element, on pages where such elements hold a fair share of the words); every tag
costs, the more the likelier it stands outside of content. One linear scan finds the contiguous run of highest total. All
its text is the result but for what stands in furniture (an aside or a form within an article) and for blocks of links
alone. The weights come from labelled pages: those that mark their own content with one article or main element, counted
over at most TRAINING_PAGES of them, on top of PRIOR, which alone decides where no page is labelled.

A class, id or role marks furniture by its own meaning: `comments` and `site-header` do, `has-comments`, `no-sidebar`,
`search-page` and `article-header` tell something else. An element that holds MOST of the page's words outside of links
is no furniture whatever its class.

Defined results: null or empty html and pages without content give the empty text; null page_id and url stay null;
repeated rows give repeated rows; an empty table gives none; extra columns are ignored; unclosed tags, comments, quotes
and scripts end where the page ends; broken character references stay as they are; of regions that score alike the first
one counts; very long and deeply nested pages are read whole, in time proportional to their length.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import clean_ids, spread, table

#: Pages, those with the smallest hashes of their url and id, from which weights are counted.
TRAINING_PAGES = 2_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|button)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>?.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*+>?)"
    r"|<[!?/][^>]*+>?",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])(?:hidden(?![\w-])|style\s*=\s*(?:\"[^\"]*\bdisplay\s*:\s*none|'[^']*\bdisplay\s*:\s*none)|aria-hidden\s*=\s*[\"']?true)", re.I)
_QUOTED = re.compile(r"((?<![\w-])(?:style|aria-hidden)\s*=\s*)?(\"[^\"]*\"|'[^']*')", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav aside footer form menu dialog head fieldset header address".split())
#: Words in a class, id or role that mark menus, notices, adverts, comments and the like.
_SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus "
    "dialog footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related replies reply "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: First parts of names that tell what a page has, not what an element is; last parts that name a page or its layout.
_STATES = frozenset("has no not with without is show hide when".split())
_WHOLES = frozenset("page layout template enabled open active on view wrap wrapper container".split())
#: Parts that make a header one of the content.
_CONTENT = frozenset("article content entry post story main title".split())
#: Share of a page's words, outside of links, from which on an element is no furniture.
MOST = 0.6
#: Share of a page's words, outside of links and furniture, from which on article elements tell where the content is.
FAIR = 1 / 3
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd div section article main td th tr table blockquote pre figure figcaption body html nav aside footer header form summary details".split())
#: Words inside and outside of content for each kind of block, as if counted before: (inside, outside).
PRIOR = {"p": (80, 20), "h1": (8, 4), "h2": (8, 4), "h3": (8, 5), "h4": (6, 5), "blockquote": (9, 1), "pre": (9, 1), "li": (5, 5), "td": (5, 5), "dd": (6, 4), "figcaption": (6, 4), "article": (8, 2), "main": (7, 3)}
_REST = (4, 6)


def _signed(named: str) -> bool:
    """Does a name among those of class, id or role mark furniture?"""
    for name in named.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not parts or _SIGNS.isdisjoint(parts) or parts[0] in _STATES or parts[-1] in _WHOLES:
            continue
        if "header" in parts and not _CONTENT.isdisjoint(parts) and len(_SIGNS.intersection(parts)) == 1:
            continue
        return True
    return False


def _hidden(attributes: str) -> bool:
    return bool(_HIDDEN.search(_QUOTED.sub(lambda m: m[0] if m[1] else '""', attributes)))


def parse(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[tuple[str, str, int, int]], bool]:
    """Items in page order: ("<", tag name, 1 in content, else 0, 0) or (kind of the words, raw text, number of the block, words).

    And whether article elements tell where the content is. `spared` are numbers of elements that are no furniture.
    """
    items: list[tuple[str, str, int, int]] = []
    open_: list[tuple[str, bool, bool, int, int]] = []  # block elements: name, furniture, article, number or -1, words before
    names: dict[str, int] = {}  # how many elements of each name are open
    furniture = articles = links = block = number = 0
    words = clear = inside = 0  # outside of links: all, outside of furniture, in articles
    large: set[int] = set()
    held: list[tuple[int, int]] = []  # elements that their class, or being a form, marks: number, words
    at = 0

    def text(raw: str) -> None:
        nonlocal words, clear, inside
        if raw:
            near = open_[-1][0] if open_ else "body"
            n = len(raw.split())
            if not links:
                words += n
                clear += 0 if furniture else n
                inside += n if articles and not furniture else 0
            items.append((f"{near if near in _BLOCKS else 'other'}|{'a' if links else ''}{'x' if furniture else ''}|{'A' if articles else 'O'}", raw, block, n))

    def pop() -> None:
        nonlocal furniture, articles
        name, was_furniture, was_article, own, before = open_.pop()
        names[name] -= 1
        furniture -= was_furniture
        articles -= was_article
        if own >= 0:
            held.append((own, words - before))

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            items.append(("", " ", block, 0))
            continue
        if name == "a":
            links = 0 if m["close"] else 1
        if name in _INLINE or name in _VOID:
            if name == "hr":
                block += 1
            items.append(("<", name, int(articles > 0 and not furniture), 0))
            continue
        block += 1
        links = 0
        content = articles > 0 and not furniture
        if m["close"]:
            if names.get(name):
                while open_[-1][0] != name:
                    pop()
                pop()
        else:
            if name == "p" or name == "li":
                while open_ and open_[-1][0] in (("p",) if name == "p" else ("p", "li")):
                    pop()
            article = name in ("article", "main")
            own = -1
            bad = name in _FURNITURE and not (name in ("header", "address") and articles)
            if name == "form" or not bad and name not in ("html", "body"):
                named = " ".join(x for found in _NAMED.findall(m["attributes"]) for x in found)
                if name == "form" or named and _signed(named) or _hidden(m["attributes"]):
                    number += 1
                    own = number
                    bad = own not in spared
            open_.append((name, bad, article and not bad, own, words))
            names[name] = names.get(name, 0) + 1
            furniture += bad
            articles += article and not bad
            content = articles > 0 and not furniture
        items.append(("<", name, int(content), 0))
    text(page[at:])
    while open_:
        pop()
    large = {own for own, n in held if n > MOST * words}
    if large and not spared:
        return parse(page, frozenset(large))
    return items, inside > 0 and inside >= FAIR * clear


def evidence(page: str, counts: dict[str, list[int]]) -> None:
    """Add a page's words and tags, inside and outside of its article, to the counts; nothing if it marks none."""
    items, labelled = parse(page)
    if not labelled:
        return
    for kind, text, inside, n in items:
        if kind == "<":
            counts.setdefault(f"<{text if text in _BLOCKS or text in _INLINE else 'other'}", [0, 0])[not inside] += 1
        elif kind:
            counts.setdefault(kind, [0, 0])[not kind.endswith("A") or "x" in kind] += n


class Weights:
    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.words: dict[str, float] = {}
        self.tags: dict[str, float] = {}
        merged: dict[str, list[float]] = {}
        for kind, (inside, outside) in counts.items():
            if kind[0] == "<":
                self.tags[kind[1:]] = 0.1 + 3 * (outside + 1) / (inside + outside + 2)
            else:
                base = kind[: kind.rindex("|")]
                for key in (kind, base):  # a page without an article has the average of both places
                    have = merged.setdefault(key, [0, 0])
                    have[0] += inside
                    have[1] += outside
        self.counts = merged

    def word(self, kind: str, labelled: bool) -> float:
        key = kind if labelled else kind[: kind.rindex("|")]
        known = self.words.get(key)
        if known is None:
            block, flags = key.split("|")[:2]
            inside, outside = PRIOR.get(block, _REST)
            if flags:
                inside, outside = (0.5, 9.5) if "x" in flags else (inside / 4, outside)
            elif labelled:
                inside, outside = (inside, outside / 8) if kind.endswith("A") else (inside / 8, outside)
            have = self.counts.get(key, (0, 0))
            known = self.words[key] = (inside + have[0]) / (inside + outside + have[0] + have[1])
        return known

    def tag(self, name: str) -> float:
        return self.tags.get(name if name in _BLOCKS or name in _INLINE else "other", 0.2 if name in _BLOCKS or name in _INLINE else 1.0)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end (exclusive) of the contiguous run with the highest sum, the first of them; (0, 0) if none is above 0."""
    best, best_from, best_to = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, begin, i + 1
    return best_from, best_to


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    items, labelled = parse(page)
    scores = [-weights.tag(text) if kind == "<" else n and n * weights.word(kind, labelled) for kind, text, _, n in items]
    begin, end = best_run(scores)
    blocks: dict[int, list[tuple[str, bool]]] = {}
    for kind, text, block, n in items[begin:end]:
        if kind == "<":
            continue
        if not kind:
            blocks.setdefault(block, []).append((text, False))
            continue
        flags, place = kind.rsplit("|", 2)[1:]
        if "x" in flags or (labelled and place == "O" and n and weights.word(kind, labelled) < 0.5):
            continue
        plain = n > 0 and ("a" not in flags or weights.word(kind, labelled) >= 0.5)
        blocks.setdefault(block, []).append((entities.unescape(text) if "&" in text else text, plain))
    joined = (" ".join("".join(text for text, _ in x).split()) for x in blocks.values() if any(plain for _, plain in x))
    return "\n\n".join(x for x in joined if x)


def learn(pages: DataFrame, limit: int = TRAINING_PAGES) -> Weights:
    """Weights from the labelled among `limit` pages; the kinds counted are few, whatever the pages hold."""

    def count(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column("html").to_pylist():
                evidence(page, counts)
        rows = [(k, *v) for k, v in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["kind", "inside", "outside"])

    place = F.xxhash64("url", "page_id")
    last = pages.where("html is not null").select(place.alias("place")).orderBy("place").limit(limit).agg(F.max("place")).first()[0]
    sample = pages.where("html is not null").where(place <= F.lit(last)).select("html")  # the texts stay where they are
    found = sample.mapInArrow(count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return Weights({r.kind: (r.inside, r.outside) for r in found.collect()})


def extract(pages: DataFrame, limit: int = TRAINING_PAGES) -> DataFrame:
    """page_id, url, the page's main text and its length in code points."""
    pages = clean_ids(pages, "page_id", "url", "html")
    weights = learn(pages, limit)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x, weights) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return spread(pages).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
