"""Queries on page layout and on what surrounds a reply, over tables given in the code and the feeds."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.operators import layout as Y
from passagework.operators import replies as P
from passagework.plans.values import sql, table
from passagework.sources import files, sinks
from passagework.streaming import feeds

_LINES = {1: "35 ( 30,5 ) 1,000. x", 2: " दो  भाग, 7.", 3: ".,9"}
CHARS = [(1, line, i, c, 10.0 * i, 5.0 + line, 10.0 * i + 8, 15.0 + line + (i % 3)) for line, t in _LINES.items() for i, c in enumerate(t)]
BOXES = [
    (1, 0.0, 10.0, 200.0, 40.0, True, False, "आइए करते हैं"), (1, 0.0, 60.0, 90.0, 90.0, True, False, "तुल्य भिन्न"), (1, 0.0, 100.0, 300.0, 250.0, True, False, "चर्चा कीजिए " + "शब्द " * 20), (1, 0.0, 5.0, 595.0, 30.0, True, False, "चौड़ा शीर्षक यहाँ"), (1, 0.0, 0.0, 100.0, 470.5, True, True, "जल चिह्न"),
    (2, 0.0, 0.0, 300.0, 150.0, False, True, ""), (2, 0.0, 200.0, 100.0, 230.0, True, False, "12 34"), (2, 10.0, 300.0, 80.0, 310.0, True, False, "पतला डिब्बा"), (3, 0.0, 0.0, 10.0, 10.0, False, False, ""), (2, 0.0, 400.0, 100.0, 420.0, True, False, "क्ा है"),
]
WORDS = [(1, "1-1", 1, "दो", 40.0, 0.0, 60.0, 9.0, 90), (1, "1-1", 2, "एक", 10.0, 1.0, 30.0, 10.0, 58), (1, "1-2", 3, "॰", 5.0, 20.0, 8.0, 25.0, 20), (1, "1-2", 4, "तीन", 5.0, 20.0, 20.0, 30.0, 95), (2, "1-1", 5, "x", 0.0, 0.0, 5.0, 5.0, 40)]
DIGITS = [(1, "225", "10", False, "10"), (2, "१५भाग", "15", False, "15भाग"), (3, "भाग3", None, False, "भाग"), (4, "12", None, False, None), (5, "शब्द", "7", False, "शब्द"), (6, "अ12", "9", True, "9")]
ERRORS = [(1, "Limit: tokens per day used"), (2, "TPD spent"), (3, "Rate limit reached, retry"), (4, "bad request"), (5, "")]
HEADERS = [(1, "HTTP/2 200\nx-ratelimit-remaining: 5\nX-RateLimit-Reset: 1:30\netag: a"), (2, "none")]
ATTEMPTS = [(1, 1, True, "a"), (2, 1, False, "b"), (2, 2, True, "c"), (3, 1, False, "d"), (3, 2, False, "e"), (4, 1, False, "f"), (4, 2, False, "g"), (4, 3, True, "h")]
GATES = [(1, True, "figure_value_lookup", "query_pre_check", "refuse", 5), (2, True, "answer_is_in_a_chart", "chart_axis", "refuse", 6), (3, True, "too_short", "query_pre_check", "clarify", 7), (4, False, None, None, "pass", 8), (5, True, "below_similarity_floor", "similarity", "refuse", None)]
READINGS = [(1, "चित्र में शेर बाईं ओर है"), (2, "NONE - nothing there"), (3, "कुछ तो लिखा हुआ है यहाँ"), (4, "छोटा")]
SPOKEN = {"too_short": "थोड़ा और बताइए।", "below_similarity_floor": "यह किताब में नहीं मिला।"}
REWRITES = [(1, "भिन्न क्या है", "bhinn kya hai"), (2, "still latin text", "abhi bhi"), (3, "", "kuch"), (4, None, "kya"), (5, "भिन्न ab", "x")]
PASSAGES = [(1, "पेज 123 में 45 और 6 हैं 0", "45 क्या है"), (2, "no numbers", "x"), (3, "7 7 8", "9")]
WINDOWS = [(1, "kitten", "xx sitting kitten yy", "kitten"), (2, "abc", "zzabdzzabc", "abc"), (3, "long text", "short", "short"), (4, "ab", "xbax", "xb")]
PAIRS = [(1, "kitten", "sitting"), (2, "", ""), (3, "a", ""), (4, "same", "same")]
SECRET = "not a real secret"
SIGNED = [(1, "body", True), (2, "body", False), (3, "", True)]
SERVICES = [("asr", 0, "en", "s1"), ("asr", 1, "hi", "s2"), ("tts", 0, "en", "s3"), ("tts", 1, "ta", "s4"), ("nmt", 0, "en", "s5"), ("nmt", 1, None, "s6")]
BUNDLE = [("app.py",), ("page.PNG",), ("secret.env",), ("data.json",)]
REQUIRED = [("app.py",), ("index.npz",)]
VARIANTS = [("a", 0.0653, 0.2), ("b", 0.074, 0.2), ("c", 0.0653, 0.1), ("d", 0.09, 0.3)]
SETS = [(1, ["1", "2", "2"], ["2", "3"]), (2, [], ["1"]), (3, ["5"], ["5", "6"]), (4, ["b", "a"], ["a", "b"])]
CALLS = [(1, 2_000.0), (2, 150_000.0), (3, 47_000.0), (4, 2_000.0), (5, 500.0)]
_BOX = "x0 double, y0 double, x1 double, y1 double"
_message = lambda i, t, kind="text": {"id": i, "from": "9", "type": kind, **({"text": {"body": t}} if kind == "text" else {"audio": {"id": t}})}
BODIES = [(json.dumps({"entry": [{"changes": [{"value": {"messages": m, "statuses": [{"id": "s"}]}}]}]}, ensure_ascii=False),) for m in ([_message("m1", "एक किलो में कितने ग्राम?")], [], [_message("m2", "  "), _message("m3", "a1", "audio")], [_message("m4", "x" * 501)])]


def q_word_assembly(spark, sf):
    return Y.words(table(spark, f"page int, line int, pos int, c string, {_BOX}", CHARS)).drop("run")


def q_digit_runs(spark, sf):
    return Y.numbers(table(spark, f"page int, line int, pos int, c string, {_BOX}", CHARS))


def q_markers(spark, sf):
    return Y.markers(table(spark, f"page int, {_BOX}, filled boolean, image boolean, text string", BOXES), 600.0)


def q_figure_share(spark, sf):
    return Y.figure_share(table(spark, f"page int, {_BOX}, filled boolean, image boolean, text string", BOXES), 480_000.0)


def q_line_assembly(spark, sf):
    return Y.assembled(table(spark, f"page int, line string, id int, text string, {_BOX}, conf int", WORDS))


def q_ocr_stats(spark, sf):
    return Y.ocr_stats(table(spark, f"page int, line string, id int, text string, {_BOX}, conf int", WORDS))


def q_digit_substitution(spark, sf):
    rows = table(spark, "id int, word string, number string, used boolean, want string", DIGITS)
    return rows.select("id", Y.substituted(F.col("word"), F.col("number"), F.col("used")).alias("word"))


def q_error_kinds(spark, sf):
    return table(spark, "id int, m string", ERRORS).select("id", P.error_kind(F.col("m")).alias("kind"))


def q_header_limits(spark, sf):
    found = P.limits(F.col("h"))
    return table(spark, "id int, h string", HEADERS).select("id", found["x-ratelimit-remaining"].alias("remaining"), found["x-ratelimit-reset"].alias("reset"))


def q_retry(spark, sf):
    return P.final(table(spark, "id int, attempt int, ok boolean, raw string", ATTEMPTS))


def q_figure_rescue(spark, sf):
    return P.rescued(table(spark, "id int, refuse boolean, reason string, layer string, outcome string, page int", GATES), table(spark, "id int, text string", READINGS))


def q_refusal(spark, sf):
    rows = table(spark, "id int, refuse boolean, reason string, layer string, outcome string, page int", GATES).where("refuse")
    return rows.select("id", P.refusal(F.col("reason"), F.col("layer"), F.col("outcome"), F.col("page"), SPOKEN).alias("r")).select("id", "r.*")


def q_rewrite_accept(spark, sf):
    return table(spark, "id int, r string, o string", REWRITES).select("id", P.kept_if_target(F.col("r"), F.col("o")).alias("text"))


def q_stub_answer(spark, sf):
    return table(spark, "id int, p string, q string", PASSAGES).select("id", P.stub(F.col("p"), F.col("q")).alias("example"), P.declined(F.col("p"), "no").alias("declined"))


def q_best_window(spark, sf):
    return table(spark, "id int, a string, b string, want string", WINDOWS).select("id", P.best_window(F.col("a"), F.col("b")).alias("found"))


def q_likeness(spark, sf):
    return table(spark, "id int, a string, b string", PAIRS).select("id", F.round(P.likeness(F.col("a"), F.col("b")), 6).alias("likeness"))


def q_signatures(spark, sf):
    import hashlib
    import hmac

    rows = [(i, b, "sha256=" + (hmac.new(SECRET.encode(), b.encode(), hashlib.sha256).hexdigest() if ok else "0" * 64)) for i, b, ok in SIGNED]
    return table(spark, "id int, b string, s string", rows).select("id", P.signed(F.col("b"), F.col("s"), SECRET).alias("ok"))


def q_service_choice(spark, sf):
    return files.preferred(table(spark, "pipeline string, place int, language string, service string", SERVICES))


def q_bundle_check(spark, sf):
    there = table(spark, "name string", BUNDLE)
    return sinks.missing(table(spark, "name string", REQUIRED), there, "name").withColumn("problem", F.lit("missing")).unionByName(sinks.forbidden(there, "name").withColumn("problem", F.lit("forbidden")))


def q_best_variant(spark, sf):
    return table(spark, "name string, cer double, recall double", VARIANTS).agg(F.min_by("name", F.struct("cer", -F.col("recall"))).alias("best"), F.min("cer").alias("cer"))


def q_set_algebra(spark, sf):
    a, b = F.col("a"), F.col("b")
    show = lambda x: F.concat_ws(",", F.array_sort(x))
    return table(spark, "id int, a array<string>, b array<string>", SETS).select("id", show(F.array_union(a, b)).alias("union"), show(F.array_intersect(a, b)).alias("both"), show(F.array_except(a, b)).alias("only"), (F.size(F.array_except(a, b)) == 0).alias("subset"), (a == b).alias("same"))


def q_daily_budget(spark, sf):
    """Calls that a day's budget still covers when they are made in order."""
    spent = F.sum("tokens").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, "id int, tokens double", CALLS).select("id", spent.alias("spent"), (spent <= 200_000).alias("allowed"))


def q_feed_routes(spark, sf):
    """Messages of webhook bodies with their way; receipts yield none."""
    rows = feeds.messages(table(spark, "body string", BODIES))
    return rows.select("id", "type", feeds.route(F.col("type"), F.col("text")).alias("way"))


def q_page_hosts(spark, sf):
    """Hosts of crawled addresses, and how much text their pages have."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.length(F.regexp_replace("html", "<[^>]*>", " ")).alias("chars"))


_C, _B, _W = sql("k", "page, line, pos, c, x0, y0, x1, y1", CHARS), sql("b", "page, x0, y0, x1, y1, filled, image, text", BOXES), sql("w", "page, line, id, text, x0, y0, x1, y1, conf", WORDS)
_G, _D = sql("g", "id, refuse, reason, layer, outcome, page", GATES), "min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1"
_NW = "abs(y1 - y0 - 470) >= 2"
_CALL = "case when regexp_matches(text, 'शिक्षण\\s*संकेत') then 'teaching_hint' when regexp_matches(text, 'आइए\\s*(पता|कर|देख|खेल|समझ)') or regexp_matches(text, 'मनोरंजन') then 'activity' when regexp_matches(text, 'प्रयत्न\\s*कीजिए') then 'try_this' when regexp_matches(text, 'चर्चा\\s*कीजिए') then 'discuss' when regexp_matches(text, 'मेरी\\s*(दिनचर्या|बारी)') then 'my_turn' end"
_READ = "case when trim(text) <> '' and not contains(upper(substring(trim(text), 1, 40)), 'NONE') and not contains(substring(trim(text), 1, 20), 'अपर') and length(trim(text)) >= 12 then trim(text) end"

QUERIES = {
    "q_word_assembly": (q_word_assembly, f"with {_C}, r as (select *, sum((c = ' ')::int) over (partition by page, line order by pos) as run from k) select page, line, string_agg(c, '' order by pos) as text, {_D} from r where c <> ' ' group by page, line, run"),
    "q_digit_runs": (q_digit_runs, f"with {_C}, r as (select *, sum((not regexp_matches(c, '[0-9,.]'))::int) over (partition by page, line order by pos) as run from k), f as (select *, min(pos) filter (regexp_matches(c, '[0-9]')) over (partition by page, line, run) as first from r) select page, line, rtrim(string_agg(c, '' order by pos), ',.') as text, {_D} from f where regexp_matches(c, '[0-9,.]') and pos >= first group by page, line, run"),
    "q_markers": (q_markers, f"""with {_B}, n as (select *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n, x1 - x0 as w, y1 - y0 as h from b), p as (select *, h <= 46 and n <= 10 and w <= 372 as pill, {_CALL} as label from n),
        m as (select * from p where filled and w >= 55 and h between 15 and 200 and {_NW} and n between 2 and case when pill then 10 else 140 end and len(regexp_extract_all(text, '[ऀ-ॿ]+')) >= 2)
        select page, row_number() over (partition by page order by y0, x0) as place, case when pill then 'section_header' || coalesce(':' || label, '') else coalesce(label, 'aside') end as kind, text, round(h, 1) as height, regexp_matches(text, '्[ा-ौ]') as label_uncertain from m"""),
    "q_figure_share": (q_figure_share, f"with {_B} select page, round(coalesce(sum((x1 - x0) * (y1 - y0)) filter ((image or filled) and (x1 - x0) * (y1 - y0) >= 6000 and {_NW}), 0) / 480000, 3) as share from b group by page"),
    "q_line_assembly": (q_line_assembly, f"with {_W} select page, line, string_agg(text, ' ' order by x0, id) as text, {_D} from w group by page, line"),
    "q_ocr_stats": (q_ocr_stats, f"with {_W}, s as (select page, list_sort(list(conf)) as v, count(*) as words, round(avg(conf), 1) as mean, round(avg((conf < 60)::int), 3) as low_share, count(*) filter (not regexp_matches(text, '[ऀ-ॿ0-9A-Za-z]') or conf < 30 or (length(text) <= 2 and conf < 55)) as dropped from w group by page) select page, words, mean, v[(words // 4)::int + 1] as p25, low_share, dropped from s"),
    "q_digit_substitution": (q_digit_substitution, f"with {sql('d', 'id, w, n, u, word', DIGITS)} select id, word from d"),
    "q_error_kinds": (q_error_kinds, f"with {sql('e', 'id, m', ERRORS)} select id, case when contains(m, 'tokens per day') or contains(m, 'TPD') then 'exhausted' when contains(lower(m), 'rate limit') then 'wait' else 'other' end as kind from e"),
    "q_header_limits": (q_header_limits, f"with {sql('h', 'id, h', HEADERS)} select id, nullif(regexp_extract(h, '(?im)^x-ratelimit-remaining:\\s*(.*)$', 1), '') as remaining, nullif(regexp_extract(h, '(?im)^x-ratelimit-reset:\\s*(.*)$', 1), '') as reset from h"),
    "q_retry": (q_retry, f"with {sql('a', 'id, attempt, ok, raw', ATTEMPTS)} select id, arg_min(raw, attempt) filter (ok) as raw, max(attempt) > 1 as retried from a where attempt <= 2 group by id"),
    "q_figure_rescue": (q_figure_rescue, f"with {_G}, {sql('r', 'id, text', READINGS)}, j as (select g.*, {_READ} as reading, refuse and reason in ('figure_value_lookup', 'answer_is_in_a_chart') and {_READ} is not null as lift from g left join r using (id)) select id, refuse and not coalesce(lift, false) as refuse, case when not coalesce(lift, false) then reason end as reason, case when lift then reading end as reading from j"),
    "q_refusal": (q_refusal, f"with {_G} select id, case reason when 'too_short' then 'थोड़ा और बताइए।' when 'below_similarity_floor' then 'यह किताब में नहीं मिला।' else '{P.DEFAULT}' end as spoken, case when outcome = 'clarify' then 'clarify' else 'refusal' end as kind, case when layer not in ('query_pre_check', 'query_vocabulary', 'class_metadata') then page end as page from g where refuse"),
    "q_rewrite_accept": (q_rewrite_accept, f"with {sql('x', 'id, r, o', REWRITES)} select id, case when trim(coalesce(r, '')) <> '' and coalesce(len(regexp_extract_all(r, '[A-Za-z]')) / nullif(len(regexp_extract_all(r, '[A-Za-zऀ-ॿ]')), 0), 0) < 0.4 then r else o end as text from x"),
    "q_stub_answer": (q_stub_answer, f"with {sql('x', 'id, p, q', PASSAGES)}, f as (select *, list_concat(list_filter(regexp_extract_all(p, '\\d+'), lambda n: not list_contains(regexp_extract_all(q, '\\d+'), n) and length(n) <= 2 and n <> '0'), ['2', '4']) as v from x) select id, '3. जैसे ' || v[1] || ' और ' || v[2] as example, contains(substring(p, 1, 80), 'no') as declined from f"),
    "q_best_window": (q_best_window, f"with {sql('x', 'id, a, b, found', WINDOWS)} select id, found from x"),
    "q_likeness": (q_likeness, f"with {sql('x', 'id, a, b', PAIRS)} select id, case when greatest(length(a), length(b)) = 0 then 1 else round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) end as likeness from x"),
    "q_signatures": (q_signatures, f"with {sql('x', 'id, b, ok', SIGNED)} select id, ok from x"),
    "q_service_choice": (q_service_choice, f"with {sql('s', 'pipeline, place, language, service', SERVICES)} select pipeline, arg_min(service, (case when language is null or language = 'hi' then 0 else 1 end, place)) as service from s group by pipeline"),
    "q_bundle_check": (q_bundle_check, f"with {sql('b', 'name', BUNDLE)}, {sql('r', 'name', REQUIRED)} select name, 'missing' as problem from r where name not in (select name from b) union all select name, 'forbidden' from b where regexp_matches(lower(name), '\\.(pdf|png|jpg|env)$')"),
    "q_best_variant": (q_best_variant, f"with {sql('v', 'name, cer, recall', VARIANTS)} select arg_min(name, (cer, -recall)) as best, min(cer) as cer from v"),
    "q_set_algebra": (q_set_algebra, f"with {sql('s', 'id, a, b', SETS)}, t as (select id, a::varchar[] as a, b::varchar[] as b from s) select id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as \"union\", array_to_string(list_sort(list_intersect(a, b)), ',') as both, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: not list_contains(b, x)))), ',') as only, list_has_all(b, a) as subset, a = b as same from t"),
    "q_daily_budget": (q_daily_budget, f"with {sql('c', 'id, tokens', CALLS)} select id, sum(tokens) over (order by id) as spent, sum(tokens) over (order by id) <= 200000 as allowed from c"),
    "q_feed_routes": (q_feed_routes, "with x(id, type, way) as (values ('m1', 'text', 'answer'), ('m2', 'text', 'ask_again'), ('m3', 'audio', 'voice_reply'), ('m4', 'text', 'too_long')) select * from x"),
    "q_page_hosts": (q_page_hosts, "select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) as chars from pages"),
}
