"""Rules on questions and texts: the pre-check cascade, tags, text repair, Romanised Hindi, query expansion."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions import lexicon as L
from passagework.functions import text as T

DEV = "[ऀ-ॿ]"
CONSONANT = "[क-हक़-य़]"
MARK = "[ऀ-ःऺ-ॏ॑-ॗॢॣ]"
START = f"(?<!{DEV})"
STEM_END = f"(?:(?!{CONSONANT})|(?={'|'.join(L.INFLECTIONS)}))"
COPYING = r"सारे\s*सवाल|सब\s*सवाल|सभी\s*सवाल|जवाब\s*लिखकर|सिर्फ\s*जवाब|केवल\s*जवाब|बिना\s*समझाए|होमवर्क\s*कर(ा|\s*दी)|पूरा\s*होमवर्क"
FIGURE = r"(?:चित्र\s*में|आकृति\s*में|नक्शे\s*में|नक्शा\s*में|मानचित्र\s*में|तालिका\s*में|आरेख\s*में|ग्राफ\s*में|दिखाई\s*गई|दिए\s*गए\s*चित्र)"
VALUE, METHOD, ASKING = "(?:कहाँ|कितने|कितना|कितनी|क्या|कौन)", "(?:कैसे|मतलब|क्यों|तरीका|विधि|समझा)", "(?:क्या|कैसे|कितने|कितना|कौन|कहाँ|क्यों|कब)"
LEAST_TOKENS = 4


def either(words: list[str]) -> str:
    """Longest first, so that a word never hides a longer one."""
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def stems(words: list[str]) -> str:
    return START + "(?:" + "|".join(words) + ")" + STEM_END


def value_seeking(q: Column) -> Column:
    return q.rlike(START + VALUE) & ~q.rlike(START + METHOD)


def beyond(q: Column) -> Column:
    return q.rlike(START + "(?:" + "|".join(L.BEYOND_WORDS) + ")") | q.rlike(f"(?i)\\b{either(L.BEYOND_WORDS_EN)}\\b") | q.rlike(r"(?<![A-Za-z])[xyzn]\d|\d[xyzn](?![A-Za-z])")


def topic_groups(q: Column) -> Column:
    return F.array_compact(F.array(*(F.when(q.rlike(stems(words)), name) for name, words in L.TOPIC_GROUPS.items())))


def pre_check(question: Column) -> Column:
    """struct(outcome, reason): the first rule that holds decides."""
    q = F.trim(question)
    tokens = F.regexp_count(q, F.lit(f"{DEV}+|[A-Za-z][A-Za-z']*"))
    marks = F.regexp_count(q, F.lit("[?？]"))
    two = ((marks >= 2) | (F.regexp_count(q, F.lit(START + ASKING)) >= 2)) & (F.size(topic_groups(q)) >= 2)
    fused = q.rlike(f"{DEV}[A-Za-z]{{1,2}}(?![A-Za-z])|(?<![A-Za-z])[A-Za-z]{{1,2}}{DEV}")
    topic = q.rlike(stems(L.TOPIC_WORDS)) | q.rlike(f"(?i)\\b{either(L.TOPIC_WORDS_EN)}\\b") | (F.regexp_count(q, F.lit(r"\d+")) >= 2)
    say = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(q.rlike(COPYING), say("refuse", "answer_copying")).when(two, say("clarify", "two_questions")).when(fused, say("clarify", "asr_suspect_code_mixed"))
        .when(q.rlike(START + FIGURE) & value_seeking(q), say("refuse", "figure_value_lookup")).when(beyond(q), say("refuse", "beyond_class5_topic_in_question"))
        .when((tokens < LEAST_TOKENS) & ~topic, say("clarify", "too_short")).when(~topic, say("clarify", "no_maths_topic")).otherwise(say("pass", None))
    )


def tags(text: Column, limit: int = 3) -> Column:
    """Distinct tags by number of matches of their best pattern, then by the patterns' order."""
    hits = F.array(*(F.struct((-F.regexp_count(text, F.lit(f"{START}(?:{p})"))).alias("n"), F.lit(i).alias("i"), F.lit(tag).alias("tag")) for i, (p, tag) in enumerate(L.TAG_VOCABULARY)))
    return F.slice(F.array_distinct(F.transform(F.array_sort(F.filter(hits, lambda x: x["n"] < 0)), lambda x: x["tag"])), 1, limit)


def primary_tag(header: Column, body: Column, chapter: Column) -> Column:
    """struct(tag, source): of the header, else of the body, else the chapter's, else `unknown`."""
    head, text = F.get(tags(header, 1), 0), F.get(tags(body, 1), 0)
    of_chapter = F.create_map(*(F.lit(x) for pair in L.CHAPTER_TAGS.items() for x in pair))[chapter]
    source = F.when(head.isNotNull(), "header").when(text.isNotNull(), "body").when(of_chapter.isNotNull(), "chapter").otherwise("none")
    return F.struct(F.coalesce(head, text, of_chapter, F.lit("unknown")).alias("tag"), source.alias("source"))


def callout(text: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(L.CALLOUTS):
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
    return kind


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; no built-in function does it."""
    return F.pandas_udf(_composed, "string")(text)


def _by_token(text: Column, table: dict[str, str]) -> Column:
    """Whole Devanagari runs replaced from a table."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    runs = F.regexp_extract_all(text, F.lit(f"({DEV}+|[^ऀ-ॿ]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.coalesce(known[x], x)), "")


def normalize(text: Column) -> Column:
    """Repair of text-layer damage: zero-width characters, doubled marks and consonants, known tokens, blanks. Null counts as empty."""
    t = F.translate(nfc(F.coalesce(text, F.lit(""))), "​‌‍﻿", "")
    for pattern, to in ((f"({CONSONANT}{MARK})\\1+", "$1"), (f"({MARK})\\1+", "$1"), (f"(्)({CONSONANT})\\2", "$1$2"), (f"({CONSONANT})\\1(?={MARK})", "$1"), (f"({CONSONANT})\\1(?!{DEV})", "$1")):
        t = F.regexp_replace(t, pattern, to)
    for table in (L.CONJUNCT_REPAIRS, L.DOUBLED_REPAIRS, L.RESTORED):
        t = _by_token(t, table)
    return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))


def normalize_header(text: Column) -> Column:
    """As normalize; then any doubled consonant becomes one."""
    return F.regexp_replace(normalize(text), f"({CONSONANT})\\1", "$1")


def dropped_consonant(text: Column) -> Column:
    return text.rlike("्[ा-ौ]")


def looks_hinglish(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)))
    hits = F.size(F.array_intersect(words, F.array(*map(F.lit, L.ROMAN_MARKERS))))
    return (T.share(T.latin(text), T.devanagari(text)) >= 0.6) & ((hits >= 2) | ((hits == 1) & (F.size(words) <= 4)))


def expanded(question: Column) -> Column:
    """The question followed by the book's words for its words, each once."""
    table = lambda words: F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    hindi = F.flatten(F.transform(F.regexp_extract_all(question, F.lit(f"({DEV}+)"), F.lit(1)), lambda w: F.coalesce(table(L.PARENT_TO_BOOK)[w], none)))
    english = F.flatten(F.transform(F.regexp_extract_all(F.lower(question), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.coalesce(table(L.ENGLISH_TO_BOOK)[w], none)))
    return F.concat_ws(" ", F.concat(F.array(question), F.array_distinct(F.concat(hindi, english))))


def axis_runs(text: Column) -> Column:
    """Runs of four or more bare numbers of one to four digits, as a chart's axis leaves them."""
    bare = "(?<![\\p{L}\\p{N}_/])\\d{1,4}(?![\\p{L}\\p{N}_/])"
    return F.transform(F.regexp_extract_all(text, F.lit(f"((?:{bare}[\\s,]+){{3,}}{bare})"), F.lit(1)), lambda x: F.trim(x))


def without_folios(text: Column, pages: Column) -> Column:
    """Without the printed page numbers that stand alone."""
    bare = F.aggregate(pages, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit("(?<![\\d/])"), p.cast("string"), F.lit("(?![\\d/])")), F.lit(" ")))
    return F.trim(F.regexp_replace(bare, "\\s{2,}", " "))


def ocr_junk(text: Column, confidence: Column) -> Column:
    return ~text.rlike("[ऀ-ॿ0-9A-Za-z]") | (confidence < 30) | ((F.length(text) <= 2) & (confidence < 55))


def page_review(unrepaired: Column, tokens: Column) -> Column:
    """Reasons for which a page goes to review; empty if it passes."""
    return F.array_compact(F.array(F.when(unrepaired > 2, F.concat(unrepaired.cast("string"), F.lit(" unrepaired"))), F.when(tokens < 20, F.concat(F.lit("only "), tokens.cast("string"), F.lit(" tokens")))))
