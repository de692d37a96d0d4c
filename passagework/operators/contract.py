"""Contracts of generated answers: numbers, labelled parts, failures by code. Texts are taken in canonical composition (rules.nfc)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions import lexicon as L
from passagework.functions import text as T
from passagework.functions.rules import DEV, START, either

PARTS = ["answer", "rule", "example", "say_to_child"]
QUOTES = "[\"'“”‘’«»]"
MOST_WORDS, FOLLOWUP_WORDS, OFTEN, ALSO, FOLLOWUP_SHARE, NEAR = 120, 70, 0.7, 0.15, 0.6, 40
END = f"(?!{DEV})"
FRACTION = f"{START}(?:({either(list(L.CARDINALS))})\\s+)?({either(list(L.DENOMINATORS))}){END}"
CARDINAL = f"{START}({either(list(L.CARDINALS))}){END}"


def _table(words: dict) -> Column:
    return F.create_map(*(F.lit(x) for k, v in words.items() for x in (k, v)))


def word_numbers(text: Column) -> Column:
    """Number words as digits: fractions first (a bare denominator is 1/n), then the cardinals outside them."""
    found = F.regexp_extract_all(text, F.lit(f"({FRACTION})"), F.lit(1))
    top = lambda x: F.coalesce(_table(L.CARDINALS)[F.regexp_extract(x, FRACTION, 1)], F.lit(1))
    fractions = F.transform(found, lambda x: F.concat_ws("/", top(x).cast("string"), _table(L.DENOMINATORS)[F.regexp_extract(x, FRACTION, 2)].cast("string")))
    rest = F.regexp_replace(text, FRACTION, "\u0001")
    return F.concat(fractions, F.transform(F.regexp_extract_all(rest, F.lit(f"({CARDINAL})"), F.lit(1)), lambda x: _table(L.CARDINALS)[x].cast("string")))


def numbers(text: Column, with_words: bool = True) -> Column:
    """Numbers in lowest terms, in order, repeats included."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(T.digit_numbers(text), word_numbers(text)) if with_words else T.digit_numbers(text)
    return F.transform(found, T.reduced)


def parts(raw: Column) -> Column:
    """map(part, text): from the end of its first label at a line's start to the next label in the text."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    label = lambda i: f"(?m)^\\s*(?:{i}|{chr(0x966 + i)})\\s*[.):\\-]\\s*"
    marks = F.array(*(F.struct(F.regexp_instr(text, F.lit(label(i))).alias("at"), F.length(F.regexp_extract(text, label(i), 0)).alias("n"), F.lit(p).alias("part")) for i, p in enumerate(PARTS, 1)))
    marks = F.array_sort(F.filter(marks, lambda m: m["at"] > 0))
    cut = F.transform(marks, lambda m, i: F.struct(m["part"], F.regexp_replace(F.substring(text, m["at"] + m["n"], F.coalesce(F.get(marks, i + 1)["at"], F.length(text) + 1) - m["at"] - m["n"]), r"^\s+|\s+$", "").alias("text")))
    return F.map_from_entries(cut)


def _bad(condition: Column, code: str) -> Column:
    return F.when(condition, F.lit(code))


def failures(raw: Column, question: Column, context: Column) -> Column:
    """Codes of what a four-part answer breaks, in a fixed order."""
    p = parts(raw)
    body, asked = F.trim(F.coalesce(raw, F.lit(""))), F.trim(F.coalesce(question, F.lit("")))
    q, there = F.array_distinct(numbers(question)), F.coalesce(F.size(numbers(context, False)), F.lit(0)) > 0
    example = F.array_distinct(numbers(p["example"]))
    new = F.array_except(example, q)
    judged = p["example"].isNotNull() & ((F.size(q) > 0) | there)
    child = p["say_to_child"]
    known = F.array_union(numbers(context, False), numbers(question, False))
    dev, latin = T.devanagari(body), T.latin(body)
    few = (dev + latin > 0) & (T.share(dev, latin) < OFTEN)
    out = [_bad(F.coalesce(p[x], F.lit("")) == "", f"missing_part:{x}") for x in PARTS]
    out.append(_bad(F.size(T.tokens(body)) > MOST_WORDS, "too_long"))
    out += [_bad(F.size(T.sentences(p[x])) > 1, f"not_one_sentence:{x}") for x in PARTS[:2]]
    out += [_bad(judged & (F.size(example) == 0), "example_has_no_numbers"), _bad(judged & (F.size(new) == 0), "example_introduces_no_new_numbers"), _bad(judged & (F.size(new) == 1) & (F.size(q) > 0) & (F.size(F.array_except(q, example)) == 0), "example_reuses_question_numbers")]
    out += [_bad(child.isNotNull() & ~child.rlike(QUOTES), "part4_not_quoted"), _bad(F.size(T.sentences(child)) > 2, "part4_too_long")]
    for term, plain in L.JARGON.items():
        first = plain.split()[0]
        near = body.rlike(f"{START}{term}[^।?!\n]{{0,{NEAR}}}{first}") | body.rlike(f"{first}[^।?!\n]{{0,{NEAR}}}{START}{term}")
        out.append(_bad(body.rlike(f"{START}{term}{END}") & ~asked.rlike(f"{START}{term}{END}") & ~near, f"unglossed_jargon:{term}"))
    out += [_bad(few, "not_hindi"), _bad(~few & (latin > dev * ALSO), "too_much_latin")]
    loose = lambda x: F.transform(F.filter(numbers(p[x], False), lambda n: ~F.array_contains(known, n)), lambda n: F.concat(F.lit(f"ungrounded_number:{x}:"), n))
    grounded = F.when(F.coalesce(context, F.lit("")) != "", F.concat(*(F.coalesce(loose(x), F.array().cast("array<string>")) for x in PARTS[:2]))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_compact(F.array(*out)), grounded)


def instructions(codes: Column) -> Column:
    """One line of correction per kind of failure, each once, in order."""
    kinds = F.array_distinct(F.transform(codes, lambda c: F.split_part(c, F.lit(":"), F.lit(1))))
    return F.array_join(F.transform(kinds, lambda k: F.concat(F.lit("- fix "), k)), "\n")


_SAY = "(?s)बच्चे से कहिए\\s*[:：]\\s*(.+)"
_BODY = {"another_example": "(?s)उदाहरण\\s*[:：]\\s*(.+?)(?=बच्चे से कहिए|$)", "simpler": "(?s)आसान भाषा में\\s*[:：]\\s*(.+?)(?=बच्चे से कहिए|$)", "explain_more": "(?s)क्यों\\s*[:：]\\s*(.+)"}


def followup_parts(raw: Column, kind: Column) -> Column:
    """struct(text, say_to_child): the labelled body, else the whole text; what to say to the child, without quotes."""
    raw = F.coalesce(raw, F.lit(""))
    text = F.lit("")
    for k, pattern in _BODY.items():
        text = F.when(kind == k, F.regexp_extract(raw, pattern, 1)).otherwise(text)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.struct(strip(F.when(text == "", raw).otherwise(text)).alias("text"), F.regexp_replace(strip(F.regexp_extract(raw, _SAY, 1)), "^[\"'“”]+|[\"'“”]+$", "").alias("say_to_child"))


def followup_failures(raw: Column, kind: Column, question: Column, previous: Column, answer: Column) -> Column:
    p = followup_parts(raw, kind)
    text = p["text"]
    n = F.size(T.tokens(text))
    new, q, before = (F.array_distinct(numbers(x)) for x in (text, question, previous))
    example = kind == "another_example"
    out = [
        _bad(T.share(T.devanagari(text), T.latin(text)) < FOLLOWUP_SHARE, "not_hindi"), _bad(n > FOLLOWUP_WORDS, "too_long"), _bad(kind.isin("another_example", "simpler") & (p["say_to_child"] == ""), "missing_say_to_child"),
        _bad(example & (F.size(F.array_intersect(new, q)) > 0), "reuses_question_numbers"), _bad(example & (F.size(new) > 0) & (F.size(F.array_except(new, before)) == 0), "repeats_previous_example"),
        _bad(example & (F.size(new) == 0), "no_numbers_in_example"), _bad((kind == "simpler") & (F.coalesce(answer, F.lit("")) != "") & (n > F.size(T.tokens(answer))), "not_simpler"),
    ]
    return F.when(text == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*out)))


def message(parts_map: Column, chapter: Column, title: Column, page: Column, answered: Column, spoken: Column) -> Column:
    """The answer as one text message; a refusal is its line and an invitation to ask again."""
    part = lambda name, before: F.when(F.coalesce(parts_map[name], F.lit("")) != "", F.concat(F.lit(before), parts_map[name]))
    cite = F.when(chapter.isNotNull(), F.concat(F.lit("_किताब: अध्याय "), chapter.cast("string"), F.lit(" — "), F.coalesce(title, F.lit("")), F.lit(", पेज "), page.cast("string"), F.lit("_")))
    whole = F.array_join(F.array_compact(F.array(part("answer", ""), part("rule", "*नियम:* "), part("example", "*उदाहरण:* "), part("say_to_child", "*बच्चे से यह कहिए:*\n"), cite)), "\n\n")
    return F.substring(F.when(answered, whole).otherwise(F.concat(F.coalesce(spoken, F.lit("मुझे इसका पक्का जवाब नहीं पता।")), F.lit("\n\nकुछ और पूछना हो तो पूछिए।"))), 1, 4096)
