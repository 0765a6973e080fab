"""Personal data: base spans by pattern, and terms that give protected entities away by what the corpus tells about them.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers, leftmost and non-overlapping for each
kind. Each is a protected entity, and so is every mail domain, a class of addresses that recurs where addresses do not. How much a term discloses an entity is their pointwise mutual information over the
documents of the corpus, against the entity's own information content: log(n_both * N / (n_entity * n_term)) /
log(N / n_entity), which is 1 if the term never stands in a document without the entity. Terms are words of at least
LETTERS letters anywhere in a text that holds the entity, if they stand with it in at least SUPPORT different texts (fewer
tell a word that discloses from one that is merely rare); their counts are over all documents. From GENERALISE on, a term is generalised (to its class) in the texts that hold the entity, from REMOVE on
it is removed; elsewhere it stays, as it discloses nothing there.

All of it is DataFrame and SQL functions. The texts' copies share what is found for them, joined by two 64-bit hashes, and
only the few texts with entities take part in any join. Words are counted over all documents, of which only those leave
their task that may be candidates. Patterns repeat possessively, which Java runs as a loop, and spans are put together in
blocks, so that a text may hold any number of digits, labels and matches.

Defined results: very long texts are read whole; of overlapping spans sanitise writes the first one's placeholder; null text counts as empty and has no spans (sanitise leaves it null); a null doc_id stays null; repeated
rows give repeated rows; an empty table gives none; extra columns are ignored, or kept by sanitise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import clean_ids, marked, table, written

SUPPORT = 3
LETTERS = 3
GENERALISE = 0.8
REMOVE = 0.95
KINDS = ("email", "ip", "card", "phone")
#: The last match's end (\\G) or no character of the class before: a match that starts inside of a run starts there.
_MAIL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for any match to count, cheap to look for.
GATES = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]+\\.[0-9]'", "card": "text rlike '[0-9](?:[ -]?[0-9]){12}'", "phone": "contains(text, '+')"}
#: A run without white space that holds an at sign or a digit: its letters are no words.
_NO_WORDS = r"(?<!\S)[^\s@0-9]*+[@0-9]\S*+"
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}
_SPAN = "array<struct<start:int,end:int>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    worth = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(worth, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


#: Cells that one aggregation gathers: appending to an array copies it, so longer lists are put together from blocks.
BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _in_blocks(cells: Column, of_block) -> Column:
    """of_block(number of the block, its cells) for each BLOCK cells of a bound, non-empty array."""
    last = F.floor((F.size(cells) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: of_block(b, F.slice(cells, b * BLOCK + 1, F.lit(BLOCK))))


def _running(values: Column, kind: str, start: Column, step) -> Column:
    """What step(so far, value) comes to before each value of a short array."""
    first = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("seen"))
    return F.aggregate(values, first, lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")), lambda acc: acc["seen"])


def spans_of(text: Column, pattern: str, valid) -> Column:
    """Start and end (code points, end exclusive) of the pattern's matches for which valid(match) holds, in order.

    The text splits into what stands between matches; lengths of both, added up in turn, give every match's place.
    """
    keep = lambda m: F.when(m.isNotNull(), valid(m)).otherwise(F.lit(False))
    cells = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), keep(m).alias("keep")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["kept"], own)).otherwise(acc["kept"]).alias("kept"))

    def placed(blocks: Column) -> Column:
        shifts = _running(blocks, "int", F.lit(0), lambda at, b: at + b["at"])
        return F.flatten(F.zip_with(blocks, shifts, lambda b, shift: F.transform(b["kept"], lambda x: F.struct((x["start"] + shift).alias("start"), (x["end"] + shift).alias("end")))))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("kept"))
    return _let(_let(cells, lambda c: _in_blocks(c, lambda b, part: F.aggregate(part, none, step))), placed)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """docs with a column `_pii`: for each kind the spans, and two hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [F.when(F.expr(GATES[k]), spans_of(text, PATTERNS[k], lambda m, k=k: _valid(k, m))).otherwise(F.array().cast(_SPAN)).alias(k) for k in KINDS]
    found = docs.withColumn("_pii", F.struct(*kinds, F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")))
    return found


def _count() -> Column:
    return sum((F.size(F.col(f"_pii.{k}")) for k in KINDS[1:]), F.size("_pii.email"))


def _entities(text: Column) -> Column:
    """The entity of each base span: its kind with its address, or its digits; and the domain of each address."""

    def of(kind: str, name: str, value) -> Column:
        found = F.filter(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: _valid(kind, m))
        return F.when(F.size(F.col(f"_pii.{kind}")) > 0, F.transform(found, lambda m: F.concat(F.lit(f"{name}:"), value(m)))).otherwise(F.array().cast("array<string>"))

    names = {"ip": lambda m: m, "card": _digits, "phone": _digits}
    return F.array_distinct(F.concat(of("email", "email", F.lower), of("email", "domain", lambda m: F.lower(F.substring_index(m, "@", -1))), *(of(k, k, v) for k, v in names.items())))


def _words(text: Column, letters: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_term(letters)), F.lit(0)))


def _term(letters: int) -> str:
    return rf"\p{{L}}{{{letters},}}"


def disclosing_terms(found: DataFrame, docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, letters: int = LETTERS) -> DataFrame:
    """For each text with entities (t1, t2) the terms to generalise and to remove. found: with_base_spans() of docs."""
    n = docs.count()
    holders = found.where(_count() > 0).groupBy("_pii.t1", "_pii.t2").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), F.first("_pii").alias("_pii"))
    texts = written(holders.select("t1", "t2", "copies", _entities(F.col("text")).alias("entities"), _words(F.regexp_replace("text", _NO_WORDS, " "), letters).alias("terms")), "entities")
    mentions = texts.select("t1", "t2", "copies", F.explode("entities").alias("entity"))
    entity = written(mentions.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).drop("texts"), "entity")
    pairs = mentions.join(entity.select("entity"), "entity").join(texts.select("t1", "t2", "terms"), ["t1", "t2"]).select("t1", "t2", "entity", "copies", F.explode("terms").alias("term"))
    both = written(pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support), "both")
    asked = marked(docs.select(F.explode(_words(F.col("text"), letters)).alias("term")), both, "term").where("marked")
    terms = asked.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    told = F.log(F.col("n_both") * F.lit(float(n)) / (F.col("n_entity") * F.col("n_term")))
    share = F.try_divide(told, F.log(F.lit(float(max(n, 1))) / F.col("n_entity")))
    flagged = both.join(entity, "entity").join(terms, "term").withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", (F.col("share") >= remove).alias("remove"))
    own = pairs.join(flagged, ["entity", "term"]).groupBy("t1", "t2", "term").agg(F.max("remove").alias("remove"))
    return own.groupBy("t1", "t2").agg(F.collect_set(F.when(F.col("remove"), F.col("term"))).alias("remove"), F.collect_set(F.when(~F.col("remove"), F.col("term"))).alias("generalise"))


def with_spans(docs: DataFrame, keep_all_texts: bool, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, letters: int = LETTERS) -> DataFrame:
    """docs with a column `_pii` of all spans by kind, base ones and those of disclosing terms (generalised, removed).

    Texts without entities are kept only if keep_all_texts.
    """
    found = with_base_spans(docs)
    if not keep_all_texts:
        found = found.withColumn("text", F.when(_count() > 0, F.col("text")))
    found = written(found, "spans")
    flags = disclosing_terms(found, docs, support, generalise, remove, letters)
    flags = flags.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("remove").alias("_remove"), F.col("generalise").alias("_generalise"))
    joined = found.where(_count() > 0).join(flags, F.col("_pii.t1").eqNullSafe(F.col("_t1")) & F.col("_pii.t2").eqNullSafe(F.col("_t2")), "left")
    base = F.concat(*(F.col(f"_pii.{k}") for k in KINDS))

    def terms(chosen: str) -> Column:
        all_ = spans_of(F.col("text"), _term(letters), lambda m: F.array_contains(F.col(chosen), F.lower(m)))
        apart = F.filter(all_, lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
        return F.when(F.size(chosen) > 0, apart).otherwise(F.array().cast(_SPAN))

    pii = F.struct(*(F.col(f"_pii.{k}") for k in KINDS), terms("_generalise").alias("generalised"), terms("_remove").alias("removed"))
    none = F.struct(*(F.col(f"_pii.{k}") for k in KINDS), *(F.array().cast(_SPAN).alias(x) for x in ("generalised", "removed")))
    return joined.withColumn("_pii", pii).drop("_t1", "_t2", "_remove", "_generalise").unionByName(found.where(_count() == 0).withColumn("_pii", none))


def _listed(kinds) -> Column:
    def of(kind: str) -> Column:
        return F.transform(F.col(f"_pii.{kind}"), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.concat(*map(of, kinds))


def find_personal_data(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, letters: int = LETTERS) -> DataFrame:
    """Counts of base spans, their digest, and all spans, for every document."""
    found = with_spans(clean_ids(docs, "doc_id", "text"), False, support, generalise, remove, letters)
    counts = [F.size(f"_pii.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(_listed(KINDS), ","), 256).alias("base_sha256"), F.array_join(_listed(PLACEHOLDERS), ",").alias("spans"))


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, letters: int = LETTERS) -> DataFrame:
    """docs, all columns, whose texts have placeholders in place of all spans (overlapping ones: the first one's)."""
    held = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # no name of theirs meets ours
    found = with_spans(held, True, support, generalise, remove, letters)

    def of(kind: str) -> Column:
        return F.transform(F.col(f"_pii.{kind}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(PLACEHOLDERS[kind]).alias("said")))

    tagged = F.concat(*map(of, PLACEHOLDERS))
    text = F.col("text")

    def said_of(part: Column, after: Column) -> Column:
        """What a block's stretch of the text, from `after` on, becomes: the stretch is cut out once, and pieces out of it."""
        until = F.greatest(after, F.array_max(F.transform(part, lambda s: s["end"])))
        stretch = F.substring(text, after + 1, until - after)

        def step(acc: Column, s: Column, whole: Column) -> Column:
            said = F.concat(acc["said"], F.substring(whole, acc["at"] - after + 1, s["start"] - acc["at"]), s["said"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], said).otherwise(acc["said"]).alias("said"))

        return _let(stretch, lambda whole: F.aggregate(part, F.struct(after.alias("at"), F.lit("").alias("said")), lambda acc, s: step(acc, s, whole), lambda acc: acc["said"]))

    def cleaned(spans: Column) -> Column:
        ends = _in_blocks(spans, lambda b, part: F.array_max(F.transform(part, lambda s: s["end"])))
        blocks = _let(_running(ends, "int", F.lit(0), F.greatest), lambda after: _in_blocks(spans, lambda b, part: said_of(part, after[b])))
        rest = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(blocks, ""), F.substring(text, rest + 1, F.length(text)))

    clean = _let(F.array_sort(tagged), cleaned)
    said = found.select(F.when(F.size(tagged) > 0, clean).otherwise(text).alias("text"), "_row")
    fixed = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return said.select(*[fixed[c].alias(c) if c in fixed else F.col(f"_row.`{c}`") for c in docs.columns])


def op9_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
