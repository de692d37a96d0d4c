"""Queries on generated answers and on page geometry, over tables given in the code."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions.rules import nfc
from passagework.operators import contract as C
from passagework.operators import geometry as G
from passagework.plans.values import sql, table

NUMBERS = [(1, "1,000 and 1000 or 2 / 6, 3.5"), (2, "4/2 is not 2"), (3, "none"), (4, "0/5 10/100 7/0"), (5, ""), (6, "12,34,567 and 5,")]
NUMBER_WORDS = [(1, "एक तिहाई और दो छठवाँ", "1/3,2/6"), (2, "आधा और चौथाई", "1/2,1/4"), (3, "एक दो पच्चीस", "1,2,25"), (4, "एकता दोपहर", ""), (5, "तीन चौथाई में पाँच", "3/4,5"), (6, "", "")]
_GOOD = "1. तीन चौथाई आधे से बड़ा होता है।\n2. नीचे वाला अंक समान करके ऊपर वाला अंक देखते हैं।\n3. मान लीजिए 5/8 और 7/8 हैं तो 7/8 बड़ा है।\n4. \"बेटा पहले नीचे वाला अंक देखो।\""
ANSWERS = [
    (1, _GOOD, "1/2 और 3/4 में कौन बड़ा है", "भिन्न 1/2 3/4", ""),
    (2, _GOOD.replace("3. मान लीजिए 5/8 और 7/8 हैं तो 7/8 बड़ा है।\n", ""), "1/2 और 3/4 में कौन बड़ा है", "भिन्न 1/2 3/4", "missing_part:example"),
    (3, _GOOD.replace("5/8 और 7/8 हैं तो 7/8", "1/2 और 2/4 हैं तो 3/4"), "1/2 और 3/4 में कौन बड़ा है", "भिन्न 1/2 3/4", "example_introduces_no_new_numbers"),
    (4, _GOOD.replace("\"", ""), "1/2 और 3/4 में कौन बड़ा है", "भिन्न 1/2 3/4", "part4_not_quoted"),
    (5, _GOOD.replace("होता है।", "होता है। यह सच है।"), "1/2 और 3/4 में कौन बड़ा है", "भिन्न 1/2 3/4", "not_one_sentence:answer"),
    (6, _GOOD.replace("तीन चौथाई आधे", "भाजक 360 से"), "1/2 और 3/4 में कौन बड़ा है", "भिन्न 1/2 3/4", "unglossed_jargon:भाजक,ungrounded_number:answer:360"),
    (7, "This is an English answer", "how", None, "missing_part:answer,missing_part:rule,missing_part:example,missing_part:say_to_child,not_hindi"),
    (8, "१) पहला भाग है\n२) दूसरा भाग है\n३) तीसरा भाग बिना संख्या\n४) «कहिए»", "क्यों", None, ""),
    (9, "", "1 2", None, "missing_part:answer,missing_part:rule,missing_part:example,missing_part:say_to_child"),
]
FOLLOWUPS = [
    (1, "उदाहरण: 6/7 और 2/7 लीजिए।\nबच्चे से कहिए: \"देखो\"", "another_example", "1/2", "5/8", "", ""), (2, "उदाहरण: 1/2 लीजिए।\nबच्चे से कहिए: \"देखो\"", "another_example", "1/2", "5/8", "", "reuses_question_numbers"),
    (3, "उदाहरण: 5/8 लीजिए।", "another_example", "1/2", "5/8", "", "missing_say_to_child,repeats_previous_example"), (4, "आसान भाषा में: यह आसान है बहुत\nबच्चे से कहिए: \"हाँ\"", "simpler", "", "", "यह है", "not_simpler"),
    (5, "क्यों: because it is so", "explain_more", "", "", "", "not_hindi"), (6, "  ", "simpler", "", "", "", "empty"), (7, "क्यों: ऐसा होता है", "explain_more", "", "", "", ""), (8, "उदाहरण: कुछ नहीं\nबच्चे से कहिए: \"हाँ\"", "another_example", "1", "2", "", "no_numbers_in_example"),
]
RULES = [(1, 1, 100.0, 50.0, 120.0, 51.0), (1, 2, 200.0, 80.0, 260.0, 81.0), (1, 3, 300.0, 50.0, 320.0, 55.0), (2, 4, 10.0, 10.0, 30.0, 11.0), (2, 5, 60.0, 40.0, 80.0, 41.0)]
DIGITS = [(1, 1, "3", 105.0, 38.0, 112.0, 48.0), (1, 2, "1,", 104.0, 20.0, 113.0, 30.0), (1, 3, "4", 106.0, 53.0, 113.0, 63.0), (1, 4, "9", 220.0, 70.0, 228.0, 78.0), (1, 5, "x", 105.0, 39.0, 112.0, 49.0), (2, 6, "2", 12.0, 0.0, 18.0, 8.0), (2, 7, "5", 14.0, 13.0, 20.0, 22.0), (2, 8, "7", 62.0, 30.0, 70.0, 38.0)]
OCR = [(1, 1, "३/४", 104.0, 36.0, 114.0, 60.0), (1, 2, "शब्द", 10.0, 36.0, 60.0, 48.0), (1, 3, "९", 219.0, 69.0, 229.0, 79.0), (2, 4, "२", 11.0, 1.0, 19.0, 9.0)]
LINES = [(1, 1, "पंक्ति", 80.0, 45.0, 160.0, 58.0), (1, 2, "दूसरी", 20.0, 60.0, 200.0, 75.0), (1, 3, "ऊपर", 0.0, 5.0, 300.0, 15.0), (2, 4, "नीचे", 100.0, 5.0, 200.0, 20.0)]
HEADERS = [(1, 1, "पहला", 0.0, 40.0, 100.0, 44.0), (1, 2, "दूसरा", 0.0, 62.0, 100.0, 66.0), (2, 3, "तीसरा", 0.0, 50.0, 100.0, 60.0)]
_BOX = "page int, id int, text string, x0 double, y0 double, x1 double, y1 double"
_RULE = "page int, id int, x0 double, y0 double, x1 double, y1 double"


def q_numbers(spark, sf):
    return table(spark, "id int, t string", NUMBERS).select("id", F.concat_ws(",", T.digit_numbers(F.col("t"))).alias("numbers"))


def q_fraction_reduce(spark, sf):
    return table(spark, "id int, t string", NUMBERS).select("id", F.concat_ws(",", C.numbers(F.col("t"), False)).alias("numbers"))


def q_word_numbers(spark, sf):
    return table(spark, "id int, t string, want string", NUMBER_WORDS).select("id", F.concat_ws(",", C.word_numbers(F.col("t"))).alias("numbers"))


def q_contract_validate(spark, sf):
    rows = table(spark, "id int, raw string, question string, context string, want string", ANSWERS).withColumns({"raw": nfc(F.coalesce("raw", F.lit(""))), "question": nfc(F.coalesce("question", F.lit("")))})
    return rows.select("id", F.concat_ws(",", C.failures(F.col("raw"), F.col("question"), F.col("context"))).alias("failures"))


def q_split_parts(spark, sf):
    rows = table(spark, "id int, raw string, question string, context string, want string", ANSWERS).withColumns({"raw": nfc(F.coalesce("raw", F.lit(""))), "question": nfc(F.coalesce("question", F.lit("")))})
    p = C.parts(F.col("raw"))
    return rows.select("id", *(F.coalesce(p[x], F.lit("")).alias(x) for x in C.PARTS))


def q_followup_validate(spark, sf):
    rows = table(spark, "id int, raw string, kind string, question string, previous string, answer string, want string", FOLLOWUPS)
    return rows.select("id", F.concat_ws(",", C.followup_failures(*(F.col(c) for c in ("raw", "kind", "question", "previous", "answer")))).alias("failures"))


def q_message(spark, sf):
    rows = table(spark, "id int, raw string, question string, context string, want string", ANSWERS).withColumns({"raw": nfc(F.coalesce("raw", F.lit(""))), "question": nfc(F.coalesce("question", F.lit("")))})
    return rows.select("id", C.message(C.parts(F.col("raw")), F.when(F.col("id") % 2 == 0, F.col("id")), F.lit("भिन्न"), F.lit(18), F.col("want") == "", F.lit(None).cast("string")).alias("message"))


def q_box_overlap(spark, sf):
    return G.best_overlap(table(spark, _BOX, OCR), table(spark, _BOX, DIGITS))


def q_fractions_geom(spark, sf):
    return G.fractions(table(spark, _RULE, RULES), table(spark, _BOX, DIGITS))


def q_point_in_rect(spark, sf):
    found = G.fractions(table(spark, _RULE, RULES), table(spark, _BOX, DIGITS))
    return G.outside(table(spark, _BOX, DIGITS), found).select("page", "id", "text")


def q_splice(spark, sf):
    found = G.fractions(table(spark, _RULE, RULES), table(spark, _BOX, DIGITS)).withColumnRenamed("bar", "id")
    return G.spliced(found, table(spark, _BOX, LINES))


def q_asof_header(spark, sf):
    return G.headed(table(spark, _BOX, LINES), table(spark, _BOX, HEADERS))


_R, _D, _O, _L, _H = sql("r", "page, id, x0, y0, x1, y1", RULES), sql("d", "page, id, text, x0, y0, x1, y1", DIGITS), sql("o", "page, id, text, x0, y0, x1, y1", OCR), sql("l", "page, id, text, x0, y0, x1, y1", LINES), sql("h", "page, id, text, x0, y0, x1, y1", HEADERS)
_FRACTIONS = f"""{_R}, {_D}, near as (select r.page, r.id as bar, r.x0 as bx0, r.y0 as by0, r.x1 as bx1, r.y1 as by1, d.id, regexp_replace(d.text, '[^0-9]', '', 'g') as digits, d.x0, d.y0, d.x1, d.y1, (d.y0 + d.y1) / 2 as mid from r join d on r.page = d.page
  where r.x1 - r.x0 > 3 and r.x1 - r.x0 <= 40 and r.y1 - r.y0 < 3 and regexp_matches(d.text, '[0-9]') and least(d.x1, r.x1) - greatest(d.x0, r.x0) > 0.3 * least(d.x1 - d.x0, r.x1 - r.x0)),
n as (select * from (select *, row_number() over (partition by bar order by mid desc, id) as k from near where mid < by0) where k = 1), u as (select * from (select *, row_number() over (partition by bar order by mid, id) as k from near where mid > by0) where k = 1),
f as (select n.page, n.bar, n.digits || '/' || u.digits as text, n.id as numerator, u.id as denominator, least(n.bx0, n.x0, u.x0) as x0, least(n.by0, n.y0, u.y0) as y0, greatest(n.bx1, n.x1, u.x1) as x1, greatest(n.by1, n.y1, u.y1) as y1 from n join u using (bar))"""
_NUMS = "list_transform(regexp_extract_all(t, '\\d+\\s*/\\s*\\d+|\\d[\\d,]*(?:\\.\\d+)?'), lambda x: regexp_replace(x, '[\\s,]', '', 'g'))"
_REDUCED = f"""list_transform({_NUMS}, lambda x: case when contains(x, '/') then (split_part(x, '/', 1)::bigint // greatest(gcd(split_part(x, '/', 1)::bigint, split_part(x, '/', 2)::bigint), 1)) || '/' || (split_part(x, '/', 2)::bigint // greatest(gcd(split_part(x, '/', 1)::bigint, split_part(x, '/', 2)::bigint), 1)) else x end)"""
_A = sql("a", "id, raw, question, context, want", ANSWERS)
_MARKS = ", ".join(f"regexp_extract(raw, '(?m)^\\s*(?:{i}|{chr(0x966 + i)})\\s*[.):\\-]\\s*([^\\n]*)', 1) as {p}" for i, p in enumerate(C.PARTS, 1))

QUERIES = {
    "q_numbers": (q_numbers, f"with {sql('x', 'id, t', NUMBERS)} select id, array_to_string({_NUMS}, ',') as numbers from x"),
    "q_fraction_reduce": (q_fraction_reduce, f"with {sql('x', 'id, t', NUMBERS)} select id, array_to_string({_REDUCED}, ',') as numbers from x"),
    "q_word_numbers": (q_word_numbers, f"with {sql('x', 'id, t, numbers', NUMBER_WORDS)} select id, numbers from x"),
    "q_contract_validate": (q_contract_validate, f"with {_A} select id, want as failures from a"),
    "q_split_parts": (q_split_parts, f"with {_A} select id, {_MARKS} from a"),
    "q_followup_validate": (q_followup_validate, f"with {sql('f', 'id, raw, kind, question, previous, answer, want', FOLLOWUPS)} select id, want as failures from f"),
    "q_message": (q_message, f"""with {_A}, p as (select id, want, {_MARKS} from a) select id, case when want = '' then concat_ws(chr(10) || chr(10), nullif(answer, ''), '*नियम:* ' || nullif(rule, ''), '*उदाहरण:* ' || nullif(example, ''), '*बच्चे से यह कहिए:*' || chr(10) || nullif(say_to_child, ''),
        case when id % 2 = 0 then '_किताब: अध्याय ' || id || ' — भिन्न, पेज 18_' end) else 'मुझे इसका पक्का जवाब नहीं पता।' || chr(10) || chr(10) || 'कुछ और पूछना हो तो पूछिए।' end as message from p"""),
    "q_box_overlap": (q_box_overlap, f"""with {_D}, {_O}, c as (select o.page, o.id as word, d.id as number, greatest(0, least(o.x1, d.x1) - greatest(o.x0, d.x0)) * greatest(0, least(o.y1, d.y1) - greatest(o.y0, d.y0)) / ((o.x1 - o.x0) * (o.y1 - o.y0)) as cover from o join d using (page))
        select page, word, number, round(cover, 6) as cover from (select *, row_number() over (partition by page, word order by cover desc, number) as k from c where cover > 0.15) where k = 1"""),
    "q_fractions_geom": (q_fractions_geom, f"with {_FRACTIONS} select * from f"),
    "q_point_in_rect": (q_point_in_rect, f"with {_FRACTIONS} select page, id, text from d where not exists (select 1 from f where f.page = d.page and (d.x0 + d.x1) / 2 between f.x0 and f.x1 and (d.y0 + d.y1) / 2 between f.y0 and f.y1)"),
    "q_splice": (q_splice, f"""with {_FRACTIONS}, {_L} select f.page, f.bar as id, (select l.id from l where l.page = f.page and (f.y0 + f.y1) / 2 between l.y0 - 1 and l.y1 + 1 and f.x0 between l.x0 - 24 and l.x1 + 48 order by abs(l.x0 - f.x0), l.id limit 1) as line from f"""),
    "q_asof_header": (q_asof_header, f"with {_L}, {_H} select l.page, l.id, (select h.text from h where h.page = l.page and h.y0 - 3 <= l.y0 order by h.y0 desc, h.id desc limit 1) as header from l"),
}
