r"""Personal data: four base kinds by pattern, and terms that disclose them.

Base kinds are matched leftmost and without overlap. Spark's functions return matches
without positions, so each pattern takes the gap before a match with it (``\G`` ties a match to the
end of the one before, so a text is walked once) and positions are running sums of lengths. Possessive
loops and look-behinds on run starts keep the walk linear on very long runs; they do not change what matches.
Running sums, the union of overlapping spans and replacement go by blocks (``llm.spans``),
so a text of very many spans costs no more per span than a text of few.

Information-theoretic sanitisation: a protected entity (the text of a base
span) has information content IC = -log2 P(e), P by documents. A term that shares documents with it
discloses it by its pointwise mutual information with it, so the share
PMI(e; t) / IC(e) says how much of the entity the term gives away. Terms that reach the
threshold become spans of their own, kind ``term``: every occurrence in the whole text of each document that holds
an entity, of whichever entity. Documents without entities are out of scope and stay as they are. Terms are words, runs of letters of any length, lower-cased. Entity and term meet where one document holds
the entity and, outside its base spans and not cut by one, the term; all frequencies cover whole texts of the whole corpus.

A pair's meetings must also be unlikely to be chance. That bound (:data:`CHANCE`) counts different texts, so copies are
no evidence, while rare terms disclose an entity of a single text. One text is no estimate of how often a term comes
without the entity: a term that also stands in documents without it must meet it in :data:`MEETINGS` different texts.

Copies of a text are counted as one text with a number, and entities that stand in the same texts
are one class with one set of statistics, so a log with very many addresses pairs its words with one class, not with each address.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import chance_bits, checkpointed, fresh, pick, small
from tensorloom.llm.spans import joined_spans, let, overlay, running

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of an entity's information from which on a term discloses it.
DISCLOSURE = 0.9
#: Bound on the probability that chance makes entity and term meet in so many texts.
CHANCE = 0.01
#: Different texts in which a pair meets if the term stands without the entity too.
MEETINGS = 2

_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A whole run of digits with single separators, of 13 to 19 digits; other runs fail whole.
_CARD = r"[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# (what must hold where a match starts, the match); an empty gap may also start right after a match.
_PATTERNS = {"email": (f"(?<!{_LOCAL})", _EMAIL), "ip": "", "card": "", "phone": ("", _PHONE)}
_PATTERNS["ip"] = ("(?<![0-9])", _IP)
_PATTERNS["card"] = (r"(?<![0-9])(?<![0-9][\x20-])", _CARD)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def value(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"
_PLACE = "array<struct<kind:string,start:int,end:int>>"


def _walked(kind: str, text: Column, walk: str) -> Column:
    """All matches of ``walk`` (group 1: the gap, group 2: the match) with their places, as :data:`_SPAN`."""
    def placed(matches: Column, ends: Column) -> Column:
        return F.zip_with(matches, ends, lambda m, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    gaps = F.transform(F.regexp_extract_all(text, F.lit(walk), F.lit(1)), F.length)
    return let(F.regexp_extract_all(text, F.lit(walk), F.lit(2)), lambda matches: placed(matches, running(F.zip_with(gaps, matches, lambda g, m: g + F.length(m)), lambda a, b: a + b, 0)))


def _spans(kind: str, text: Column) -> Column:
    """Valid spans of one kind in a text, in order, as an array of :data:`_SPAN`."""
    begin, match = _PATTERNS[kind]
    found = F.filter(_walked(kind, text, rf"(?s)\G(|.*?{begin})({match})"), lambda s: _valid(kind, s["match"]))
    # Most texts hold nothing of a kind: one cheap look decides whether to walk.
    return F.when(text.rlike(begin + match), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All valid base spans of a text (null: none), by kind as listed, then start."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(*[_spans(kind, text) for kind in KINDS])


#: Stands for each code point of a base span; a noncharacter, which no text should hold.
BLANK = "\ufdd0"
# A word that a base span cuts touches the blank and is none.
_WORD = rf"(?<![\p{{L}}{BLANK}])\p{{L}}++(?!{BLANK})"


def _blanked(text: Column, spans: Column) -> Column:
    """A text with each base span blanked out, place by place."""
    return F.when(F.size(spans) == 0, text).otherwise(overlay(text, joined_spans(spans), lambda s: F.repeat(F.lit(BLANK), s["end"] - s["start"])))


def _words(text: Column) -> Column:
    """The distinct words of a text, lower-cased runs of letters."""
    joined = F.lower(F.array_join(F.split(text, r"\P{L}+"), " "))
    return F.filter(F.array_distinct(F.split(joined, " ")), lambda w: w != "")


def _term_spans(text: Column, spans: Column, terms: Column) -> Column:
    """Where a text holds the terms outside its base spans."""
    words = _walked(TERM, _blanked(text, spans), rf"(?s)\G(.*?)({_WORD})")
    hits = F.filter(words, lambda w: F.array_contains(terms, F.lower(w["match"])))
    return F.transform(hits, lambda s: F.struct(s["kind"], s["start"], s["end"]))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _key() -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(_text()).alias("a"), F.xxhash64(_text(), F.lit(1)).alias("b"))


def disclosing(docs: DataFrame, threshold: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """``(h, terms)``: the texts with entities that hold words which disclose some entity of the corpus, with these words."""
    rows = pick(docs, text="text").select(_text().alias("text"))
    held = rows.withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    names = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["match"]))))
    words = F.array_distinct(F.transform(F.regexp_extract_all(_blanked(F.col("text"), F.col("spans")), F.lit(_WORD), F.lit(0)), F.lower))
    held = held.select(_key().alias("h"), names.alias("entities"), words.alias("words"))
    # Copies are one text with a number; equal texts have equal entities and words.
    held = checkpointed(held.groupBy("h").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words")))
    n_all = F.lit(rows.count())
    mentions = held.select("h", "copies", F.explode("entities").alias("entity"))
    # Entities of the same texts are one class, named by the exclusive or of the texts' keys.
    sizes = mentions.groupBy("entity").agg(
        F.sum("copies").alias("n_entity"), F.count("*").alias("all_texts"), F.struct(F.bit_xor("h.a").alias("a"), F.bit_xor("h.b").alias("b")).alias("class")
    )
    classes = mentions.join(checkpointed(sizes), "entity").select("class", "h", "copies", "n_entity", "all_texts").distinct()
    # Counted map-side before the shuffle: what moves is words per task, not words per document.
    frequency = checkpointed(rows.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    # n_both <= n_entity, so only words this rare can reach the threshold for the text's commonest entity.
    most = classes.groupBy("h").agg(F.max("n_entity").alias("most"))
    rare = lambda n: F.col("n_term") <= n_all * F.pow(n / F.greatest(n_all, F.lit(1)), F.lit(threshold)) * (1 + 1e-9)
    uses = held.select("h", "words").join(most, "h").select("h", "most", F.explode("words").alias("term"))
    uses = uses.join(frequency, "term").where(rare(F.col("most"))).select("h", "term", "n_term")
    pairs = classes.join(uses, "h").where(rare(F.col("n_entity"))).groupBy("class", "term", "n_entity", "all_texts", "n_term")
    pairs = pairs.agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts"))
    content = F.log2(n_all / F.col("n_entity"))
    shared = F.log2(F.col("n_both") * n_all / (F.col("n_entity") * F.col("n_term")))
    likely = chance_bits(F.col("texts"), F.col("all_texts"), F.col("n_term") / n_all) >= -math.log2(chance) - 1e-9
    seen = (F.col("n_term") <= F.col("n_both")) | (F.col("texts") >= MEETINGS)
    terms = checkpointed(pairs.where((content > 0) & (shared >= threshold * content - 1e-9) & likely & seen).select("term").distinct())
    own = held.select("h", F.explode("words").alias("term")).join(small(terms, F.octet_length("term")), "term")
    return own.groupBy("h").agg(F.collect_set("term").alias("terms"))


def _marked(docs: DataFrame, base: str, more: str, threshold: float, chance: float) -> DataFrame:
    """``docs`` with its base spans (:data:`_SPAN`) and term spans (:data:`_PLACE`) as columns ``base`` and ``more``."""
    h, terms = fresh(docs, "__h", "__terms")
    held = checkpointed(disclosing(docs, threshold, chance))
    size = F.aggregate("terms", F.lit(32), lambda acc, t: acc + F.octet_length(t) + 16)
    held = small(held, size).select(F.col("h").alias(h), F.col("terms").alias(terms))
    out = docs.join(held, _key() == F.col(h), "left").withColumn(base, base_spans(F.col("text")))
    return out.withColumn(more, F.when(F.col(terms).isNotNull(), _term_spans(_text(), F.col(base), F.col(terms))).otherwise(F.array().cast(_PLACE)))


def find(docs: DataFrame, threshold: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """``(doc_id, spans)`` per row: base spans and disclosing terms, (kind, start, end) each.

    By kind (base kinds as listed, then terms), then start; offsets in code
    points, end exclusive. Null and empty texts have none. Repeated rows get
    equal spans; a null doc_id stays null; an empty table gives an empty result.
    """
    found = _marked(pick(docs, doc_id="doc_id", text="text"), "base", "more", threshold, chance)
    return found.select("doc_id", F.concat(F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"])), "more").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans as text, from :func:`find`."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, threshold: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """``docs`` with base spans generalised to ``[KIND]`` and disclosing terms removed as ``[TERM]``.

    Returns the columns of ``docs``; only text changes, and n_chars where there
    is such a column. Spans that overlap are replaced together, by the first's kind.
    """
    base, more, all_, clean = fresh(docs, "__base", "__more", "__spans", "__clean")
    found = _marked(docs, base, more, threshold, chance)
    place = lambda s: F.struct(s["kind"], s["start"], s["end"])
    found = found.withColumn(all_, F.concat(F.transform(base, place), F.col(more)))
    text = overlay(_text(), joined_spans(F.col(all_)), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    found = found.withColumn(clean, F.when(F.size(all_) == 0, F.col("text")).otherwise(text))
    own = {"text": F.col(clean), "n_chars": F.length(clean).cast("long")}
    return found.select(*[own[n].alias(n) if n in own else F.col(f"`{n}`") for n in docs.columns])
