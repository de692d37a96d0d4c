"""Ingest and rule queries: chunking over documents, language rules over tables given in the code."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.functions import lexicon as L
from passagework.functions import rules as R
from passagework.functions import text as T
from passagework.operators import chunking as C
from passagework.plans.values import sql, table

QUESTIONS = [
    (1, "सारे सवाल हल कर दो"), (2, "भिन्न क्या है और समय कैसे देखते हैं?"), (3, "नापt क्या होता है बताओ"), (4, "नक्शे में शेर कहाँ है बताइए"), (5, "नक्शे में दिशाएँ कैसे देखते हैं?"), (6, "what is the square root of 49?"),
    (7, "x2+5x+6 का हल क्या है?"), (8, "कैसे हो"), (9, "भारत की राजधानी क्या है बताइए"), (10, "1/3 और 2/6 एक जैसी कैसे हैं?"), (11, "100 नारियल को 8 में बाँटना है"), (12, "how many grams in one kilogram?"), (13, "विभिन्न रंग कौन से होते हैं"),
    (14, "प्रतिशत कैसे निकालते हैं 5 6"), (15, "जोड़ने का तरीका बताइए"), (16, "1 kg में कितने ग्राम?"), (17, ""), (18, "10 m में कितने cm होते हैं?"), (19, "टैनग्राम क्या है"), (20, "पूरा होमवर्क लिख दो"),
]
ROMAN = [(1, "bhinn kya hai batao"), (2, "how many grams in a kilogram"), (3, "1 kilogram me kitne gram hote hain"), (4, "भिन्न क्या है"), (5, "explain fraction to me"), (6, "ye kon kaise napen"), (7, ""), (8, "गुणा kaise karte hain batao"), (9, "par kya")]
AXIS = [(1, "घंटे 0 10 20 30 40 तक"), (2, "1, 2, 3, 4"), (3, "12 13 14 only"), (4, "1/2 3 4 5"), (5, "x1 2 3 4 5 6 and 7,8, 9 10 11"), (6, "12345 1 2 3 4")]
FOLIOS = [(1, "text 18 1/2 is 18", [18]), (2, "17 and 117 and 17/18  end", [17, 18]), (3, "none", [4]), (4, "5 5 55", [5])]
PASSAGES = [(1, "तुल्य भिन्न", "भिन्न भिन्न भिन्न और तुल्य भिन्न", 2), (2, None, "विभिन्न वस्तुएँ", 9), (3, "", "टैनग्राम टाइल ग्राम ग्राम भार", 7), (4, "शेष", "कुछ नहीं", 20), (5, "समय", "घंटे मिनट समय दूरी मीटर रुपये", 12), (6, None, "", None)]
CALLOUTS = [(1, "शिक्षण संकेत: ध्यान दें"), (2, "आइए करते हैं"), (3, "मनोरंजन गतिविधि"), (4, "चर्चा कीजिए"), (5, "मेरी बारी"), (6, "अन्य पाठ"), (7, "प्रयत्न कीजिए और चर्चा कीजिए")]
DAMAGED = [
    (1, "भिन्​न  है", "भिन्न है", "भिन्न है"), (2, "काााम", "काम", "काम"), (3, "रिक्तत", "रिक्त", "रिक्त"), (4, "समानन", "समान", "समान"), (5, "अध्ययन", "अध्ययन", "अध्यन"), (6, "ग्ाम", "ग्राम", "ग्राम"), (7, "ययह बात", "यह बात", "यह बात"), (8, None, "", ""),
    (9, "ममता", "ममता", "मता"), (10, "पक्का", "पक्का", "पक्का"), (11, "कीकी", "की", "की"),
]
WORDS = [(1, "था", 54), (2, "था", 55), (3, "—", 99), (4, "ग्राम", 29), (5, "ग्राम", 30), (6, "12", 90), (7, "|", 90)]
PAGES = [(1, 3, 19), (2, 2, 20), (3, 9, 100), (4, 0, 0)]
GUARD = f"(^|[^{R.DEV[1:-1]}])"
_END = f"(?:$|[^{R.CONSONANT[1:-1]}]|{'|'.join(L.INFLECTIONS)})"
HEADER = 40


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def body(spark, sf):
    return C.sections(C.lines(_read(spark, sf, "documents")), F.length("line") <= HEADER)


def q_sections(spark, sf):
    return body(spark, sf).groupBy("doc_id", "section").agg(F.first("header").alias("header"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


def q_pack_overlap(spark, sf):
    return C.packed(C.lines(_read(spark, sf, "documents")))


def q_pack_tail(spark, sf):
    return C.packed_by_size(C.lines(_read(spark, sf, "documents")))


def q_chunk_ids(spark, sf):
    """Ids of the chunks long enough, numbered from 0 within language and source."""
    docs = _read(spark, sf, "documents")
    parts = C.packed(C.lines(docs)).where(F.col("chars") >= C.LEAST).join(docs.select("doc_id", "lang", "source"), "doc_id")
    n = F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id", "part")) - 1
    return parts.select("doc_id", "part", F.format_string("c-%s-%s-%05d", "lang", "source", n).alias("chunk_id"))


def q_dup_id_guard(spark, sf):
    ids = _read(spark, sf, "documents").select(F.col("doc_id").alias("id")).unionByName(_read(spark, sf, "benchmark").select(F.col("item_id").alias("id")))
    return C.duplicate_ids(ids, "id")


def q_axis_runs(spark, sf):
    return table(spark, "id int, t string", AXIS).select("id", F.concat_ws("|", R.axis_runs(F.col("t"))).alias("runs"))


def q_strip_folio(spark, sf):
    return table(spark, "id int, t string, pages array<int>", FOLIOS).select("id", R.without_folios(F.col("t"), F.col("pages")).alias("t"))


def q_tag_top3(spark, sf):
    return table(spark, "id int, header string, body string, chapter int", PASSAGES).select("id", F.concat_ws(",", R.tags(F.col("body"))).alias("tags"))


def q_primary_tag(spark, sf):
    return table(spark, "id int, header string, body string, chapter int", PASSAGES).select("id", R.primary_tag(F.col("header"), F.col("body"), F.col("chapter")).alias("t")).select("id", "t.*")


def q_callouts(spark, sf):
    return table(spark, "id int, t string", CALLOUTS).select("id", R.callout(F.col("t")).alias("kind"))


def q_script_share(spark, sf):
    asked = table(spark, "id int, t string", QUESTIONS).select(F.lit("q").alias("source"), F.col("id").cast("bigint"), "t").unionByName(_read(spark, sf, "documents").select(F.lit("d").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("t")))
    return asked.select("source", "id", T.latin(F.col("t")).alias("latin"), T.devanagari(F.col("t")).alias("devanagari"), F.round(T.share(T.latin(F.col("t")), T.devanagari(F.col("t"))), 6).alias("share"))


def q_hinglish(spark, sf):
    return table(spark, "id int, t string", ROMAN).select("id", R.looks_hinglish(F.col("t")).alias("hinglish"))


def q_pre_check(spark, sf):
    return table(spark, "id int, t string", QUESTIONS).select("id", R.pre_check(F.col("t")).alias("p")).select("id", "p.*")


def q_query_expansion(spark, sf):
    return table(spark, "id int, t string", QUESTIONS).select("id", R.expanded(F.col("t")).alias("expanded"))


def q_normalize(spark, sf):
    return table(spark, "id int, t string, a string, b string", DAMAGED).select("id", R.normalize(F.col("t")).alias("t"))


def q_normalize_header(spark, sf):
    return table(spark, "id int, t string, a string, b string", DAMAGED).select("id", R.normalize_header(F.col("t")).alias("t"), R.dropped_consonant(F.coalesce("t", F.lit(""))).alias("dropped"))


def q_ocr_junk(spark, sf):
    return table(spark, "id int, t string, conf int", WORDS).select("id", R.ocr_junk(F.col("t"), F.col("conf")).alias("junk"))


def q_page_gate(spark, sf):
    return table(spark, "id int, u int, n int", PAGES).select("id", F.concat_ws("; ", R.page_review(F.col("u"), F.col("n"))).alias("reasons"))


def q_outside_terms(spark, sf):
    """Hits of terms of other books and of the book's own, as the filter on other books counts them."""
    t = F.col("body")
    rows = table(spark, "id int, header string, body string, chapter int", PASSAGES).select("id", "body").unionByName(table(spark, "id int, body string", QUESTIONS))
    counts = rows.select("id", "body", F.regexp_count(t, F.lit(R.START + "(?:" + "|".join(L.OUTSIDE_WORDS) + ")")).alias("outside"), F.regexp_count(t, F.lit(R.START + "(?:" + "|".join(L.TOPIC_WORDS) + ")")).alias("inside"))
    return counts.select("id", "body", "outside", "inside", (F.col("outside") >= 1).alias("keep"))


_LINES = "l as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as line_no, line from (select doc_id, unnest(range(len(x))) as i, trim(unnest(x)) as line from (select doc_id, string_split(text, chr(10)) as x from documents)) where line <> '')"
_OVER = f"""recursive {_LINES}, n as (select doc_id, max(line_no) as top from l group by doc_id),
r as (select doc_id, line_no, 0 as first, length(line) as size, null::int as done_first, null::int as done_last, null::int as done_size from l where line_no = 0
 union all select l.doc_id, l.line_no, case when r.size + length(l.line) > 1400 and l.line_no > r.first then l.line_no - 1 else r.first end, case when r.size + length(l.line) > 1400 and l.line_no > r.first then length(l.line) + length(b.line) else r.size + length(l.line) end,
  case when r.size + length(l.line) > 1400 and l.line_no > r.first then r.first end, case when r.size + length(l.line) > 1400 and l.line_no > r.first then l.line_no - 1 end, case when r.size + length(l.line) > 1400 and l.line_no > r.first then r.size end
 from r join l on l.doc_id = r.doc_id and l.line_no = r.line_no + 1 join l b on b.doc_id = r.doc_id and b.line_no = r.line_no),
parts as (select doc_id, done_first as first, done_last as last, done_size as chars from r where done_first is not null union all select r.doc_id, r.first, r.line_no, r.size from r join n on n.doc_id = r.doc_id and n.top = r.line_no),
packed as (select doc_id, row_number() over (partition by doc_id order by first, last) - 1 as part, first, last, chars from parts)"""
_TAIL = f"""recursive {_LINES}, n as (select doc_id, max(line_no) as top from l group by doc_id),
r as (select doc_id, line_no, case when length(line) >= 800 then 1 else 0 end as next_first, case when length(line) >= 800 then 0 else length(line) end as size, case when length(line) >= 800 then 0 end as first, case when length(line) >= 800 then length(line) end as chars from l where line_no = 0
 union all select l.doc_id, l.line_no, case when r.size + length(l.line) >= 800 then l.line_no + 1 else r.next_first end, case when r.size + length(l.line) >= 800 then 0 else r.size + length(l.line) end, case when r.size + length(l.line) >= 800 then r.next_first end, case when r.size + length(l.line) >= 800 then r.size + length(l.line) end
 from r join l on l.doc_id = r.doc_id and l.line_no = r.line_no + 1),
parts as (select doc_id, first, line_no as last, chars from r where first is not null union all select r.doc_id, r.next_first, r.line_no, r.size from r join n on n.doc_id = r.doc_id and n.top = r.line_no where r.size >= 200)"""
_Q = sql("q", "id, t", QUESTIONS)
_P = sql("p", "id, header, body, chapter", PASSAGES)
_TAGS = "v(i, pattern, tag) as (values " + ", ".join(f"({i}, '{p}', '{t}')" for i, (p, t) in enumerate(L.TAG_VOCABULARY)) + ")"
_CLASS = R.DEV[1:-1]


def _match(pattern: str, text: str = "t") -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _best(column: str, limit: int) -> str:
    hits = f"select p.id, tag, max(len(regexp_extract_all({column}, '{GUARD}(?:' || pattern || ')'))) as n, arg_min(i, (-len(regexp_extract_all({column}, '{GUARD}(?:' || pattern || ')')), i)) as i from p, v where {column} is not null group by p.id, tag"
    return f"(select id, tag, row_number() over (partition by id order by n desc, i) as r from ({hits}) where n > 0) where r <= {limit}"


_GROUPS = " + ".join(f"regexp_matches(t, '{GUARD}(?:{'|'.join(w)}){_END}')::int" for w in L.TOPIC_GROUPS.values())
_VALUE = f"{_match(GUARD + R.VALUE)} and not {_match(GUARD + R.METHOD)}"
_TOPIC = f"({_match(GUARD + '(?:' + '|'.join(L.TOPIC_WORDS) + ')' + _END)} or {_match('(?i)' + chr(92) + 'b' + R.either(L.TOPIC_WORDS_EN) + chr(92) + 'b')} or len(regexp_extract_all(t, '\\d+')) >= 2)"
_PRE = f"""case when {_match(R.COPYING)} then 'refuse:answer_copying' when (len(regexp_extract_all(t, '[?？]')) >= 2 or len(regexp_extract_all(t, '{GUARD}{R.ASKING}')) >= 2) and {_GROUPS} >= 2 then 'clarify:two_questions'
when {_match(f"{R.DEV}[A-Za-z]{{1,2}}($|[^A-Za-z])|(^|[^A-Za-z])[A-Za-z]{{1,2}}{R.DEV}")} then 'clarify:asr_suspect_code_mixed' when {_match(GUARD + R.FIGURE)} and {_VALUE} then 'refuse:figure_value_lookup'
when {_match(GUARD + '(?:' + '|'.join(L.BEYOND_WORDS) + ')')} or {_match('(?i)' + chr(92) + 'b' + R.either(L.BEYOND_WORDS_EN) + chr(92) + 'b')} or {_match('(^|[^A-Za-z])[xyzn][0-9]|[0-9][xyzn]($|[^A-Za-z])')} then 'refuse:beyond_class5_topic_in_question'
when len(regexp_extract_all(t, '{R.DEV}+|[A-Za-z][A-Za-z'']*')) < 4 and not {_TOPIC} then 'clarify:too_short' when not {_TOPIC} then 'clarify:no_maths_topic' else 'pass:' end"""
_SYN = "e(lang, i, word, j, target) as (values " + ", ".join(f"('{lang}', {i}, '{k}', {j}, '{x}')" for lang, words in (("hi", L.PARENT_TO_BOOK), ("en", L.ENGLISH_TO_BOOK)) for i, (k, v) in enumerate(words.items()) for j, x in enumerate(v)) + ")"

QUERIES = {
    "q_sections": (q_sections, f"""with {_LINES}, h as (select *, length(line) <= {HEADER} as head, last_value(case when length(line) <= {HEADER} then line end ignore nulls) over (partition by doc_id order by line_no) as header from l),
        b as (select *, case when row_number() over w = 1 or header is distinct from lag(header) over w then 1 else 0 end as fresh from h where not head window w as (partition by doc_id order by line_no)),
        s as (select *, sum(fresh) over (partition by doc_id order by line_no) as section from b) select doc_id, section, any_value(header) as header, count(*) as n_lines, sum(length(line)) as chars from s group by doc_id, section"""),
    "q_pack_overlap": (q_pack_overlap, f"with {_OVER} select * from packed"),
    "q_pack_tail": (q_pack_tail, f"with {_TAIL} select doc_id, row_number() over (partition by doc_id order by first) - 1 as part, first, last, chars from parts"),
    "q_chunk_ids": (q_chunk_ids, f"with {_OVER} select doc_id, part, printf('c-%s-%s-%05d', lang, source, row_number() over (partition by lang, source order by doc_id, part) - 1) as chunk_id from packed join documents using (doc_id) where chars >= 120"),
    "q_dup_id_guard": (q_dup_id_guard, "select id, count(*) as n from (select doc_id as id from documents union all select item_id from benchmark) group by id having count(*) > 1"),
    "q_axis_runs": (q_axis_runs, "with x(id, runs) as (values (1, '0 10 20 30 40'), (2, '1, 2, 3, 4'), (3, ''), (4, ''), (5, '2 3 4 5 6|7,8, 9 10 11'), (6, '1 2 3 4')) select * from x"),
    "q_strip_folio": (q_strip_folio, "with x(id, t) as (values (1, 'text 1/2 is'), (2, 'and 117 and 17/18 end'), (3, 'none'), (4, '55')) select * from x"),
    "q_tag_top3": (q_tag_top3, f"with {_P}, {_TAGS} select p.id, coalesce(string_agg(tag, ',' order by r), '') as tags from p left join (select * from {_best('body', 3)}) b using (id) group by p.id"),
    "q_primary_tag": (q_primary_tag, f"""with {_P}, {_TAGS}, h as (select * from {_best('header', 1)}), b as (select * from {_best('body', 1)}), c(chapter, tag) as (values {', '.join(f"({k}, '{v}')" for k, v in L.CHAPTER_TAGS.items())})
        select p.id, coalesce(h.tag, b.tag, c.tag, 'unknown') as tag, case when h.tag is not null then 'header' when b.tag is not null then 'body' when c.tag is not null then 'chapter' else 'none' end as source from p left join h using (id) left join b on b.id = p.id left join c on c.chapter = p.chapter"""),
    "q_callouts": (q_callouts, f"with {sql('c', 'id, t', CALLOUTS)} select id, case {' '.join(f'when {_match(p)} then ' + repr(k) for k, p in L.CALLOUTS)} end as kind from c"),
    "q_script_share": (q_script_share, f"""with {_Q}, a as (select 'q' as source, id, t from q union all select 'd', doc_id, text from documents), c as (select source, id, len(regexp_extract_all(t, '[A-Za-z]')) as latin, len(regexp_extract_all(t, '{R.DEV}')) as devanagari from a)
        select *, case when latin + devanagari > 0 then round(latin / (latin + devanagari), 6) else 0 end as share from c"""),
    "q_hinglish": (q_hinglish, f"""with {sql('x', 'id, t', ROMAN)}, w as (select id, len(regexp_extract_all(t, '[A-Za-z]')) as latin, len(regexp_extract_all(t, '{R.DEV}')) as dev, list_distinct(regexp_extract_all(lower(t), '[a-z]+')) as words from x),
        h as (select *, len(list_intersect(words, [{', '.join(repr(m) for m in L.ROMAN_MARKERS)}])) as hits from w) select id, coalesce(latin / nullif(latin + dev, 0), 0) >= 0.6 and (hits >= 2 or (hits = 1 and len(words) <= 4)) as hinglish from h"""),
    "q_pre_check": (q_pre_check, f"with {_Q}, r as (select id, {_PRE} as p from (select id, trim(t) as t from q)) select id, split_part(p, ':', 1) as outcome, nullif(split_part(p, ':', 2), '') as reason from r"),
    "q_query_expansion": (q_query_expansion, f"""with {_Q}, {_SYN}, w as (select id, 'hi' as lang, unnest(regexp_extract_all(t, '{R.DEV}+')) as word, unnest(range(1000)) as spot from q union all select id, 'en', unnest(regexp_extract_all(lower(t), '[a-z]+')), unnest(range(1000)) from q),
        m as (select id, target, min((case w.lang when 'hi' then 0 else 1000000 end) + spot * 100 + j) as pos from w join e on e.lang = w.lang and e.word = w.word group by id, target)
        select q.id, q.t || coalesce(' ' || string_agg(target, ' ' order by pos), '') as expanded from q left join m using (id) group by q.id, q.t"""),
    "q_normalize": (q_normalize, f"with {sql('d', 'id, t, a, b', DAMAGED)} select id, a as t from d"),
    "q_normalize_header": (q_normalize_header, f"with {sql('d', 'id, t, a, b', DAMAGED)} select id, b as t, regexp_matches(coalesce(t, ''), '्[ा-ौ]') as dropped from d"),
    "q_ocr_junk": (q_ocr_junk, f"with {sql('w', 'id, t, conf', WORDS)} select id, not regexp_matches(t, '[ऀ-ॿ0-9A-Za-z]') or conf < 30 or (length(t) <= 2 and conf < 55) as junk from w"),
    "q_page_gate": (q_page_gate, f"with {sql('g', 'id, u, n', PAGES)} select id, concat_ws('; ', case when u > 2 then u || ' unrepaired' end, case when n < 20 then 'only ' || n || ' tokens' end) as reasons from g"),
    "q_outside_terms": (q_outside_terms, f"""with {_P}, {_Q}, a as (select id, body from p union all select id, t from q), c as (select id, body, len(regexp_extract_all(body, '{GUARD}(?:{'|'.join(L.OUTSIDE_WORDS)})')) as outside, len(regexp_extract_all(body, '{GUARD}(?:{'|'.join(L.TOPIC_WORDS)})')) as inside from a)
        select *, outside >= 1 as keep from c"""),
}
