"""Queries on records: the production gate, extraction scores, asides, running ids, caches, quotas, small conversions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import replies as P
from passagework.operators import retrieval as R
from passagework.plans import retrieval as Q
from passagework.plans import rules
from passagework.plans.values import sql, table

HINDI = [(1, "भिन्न 1/2 किताब में 3 है।"), (2, "किताब का fraction"), (3, ""), (4, "१२ पेज"), (5, None)]
BAKED = [
    ("a", 1, ["abc 12 def", "x 3 4 4 y"], ["1/2", "3/4"], "zz abc 12 dex qq x 3 4 y 1/2", 1.5), ("a", 2, ["hello 7"], [], "hallo 7", 0.5),
    ("b", 1, ["abc 12 def", "x 3 4 4 y"], ["1/2", "3/4"], "abc 1 def x 3 4 4 y 3/4 1/2", 2.0), ("b", 2, ["hello 7"], [], "", 2.5),
]
FIGURED = [(1, 1, 0.2, 30), (1, 2, 0.5, 60), (2, 3, 0.5, 200), (3, 4, 0.34, 89), (4, 5, 0.33, 10)]
BODY = [("x", 1, 1, 10), ("x", 1, 2, 11), ("x", 3, 1, 12), ("x", 4, 1, 13), ("x", 4, 2, 14), ("y", 2, 1, 20)]
ASIDES = [("x", 1, "a"), ("x", 2, "b"), ("x", 4, "c"), ("y", 1, "d"), ("y", 2, "e"), ("z", 1, "f")]
MERGED = [(1, ["p", "q"], ["1", "2"], ["q", "r"], ["3", "4"]), (2, [], [], ["p"], ["5"]), (3, ["p"], ["6"], [], [])]
URLS = [(1, "http://x.org/a?chapter=3&page=16"), (2, "http://x.org/?page=7&page=8"), (3, "http://x.org/"), (4, "http://x.org/a?chapter=5#page=9")]
LABELLED = [(1, "प्रश्न: क्या: है?"), (2, "no label"), (3, "\"(why?)\"; then"), (4, "...")]
LINES = [("c1", 2, "second"), ("c1", 1, "first"), ("c2", 1, "only"), ("c1", 10, "tenth")]
FAILED = [(1, ["too_long"]), (2, []), (3, ["not_hindi", "too_much_latin"]), (4, ["missing_part:rule"])]
VOCABULARY = ["the", "st", "con", "zebra", "in", "tion"]
#: A page depends on its figures over this share and under so many words; tokens a minute; a score's place.
SHARE, WORDS, TOKENS_MINUTE = 0.34, 90, 8_000
PUNCTUATION = "?।,.!;:\"'()"


def q_terms_hindi(spark, sf):
    return table(spark, "id int, t string", HINDI).select("id", F.posexplode(T.terms(F.col("t"))).alias("place", "term"))


def _signals(i):
    return (i % 5) * 0.03, i % 7 == 0, i % 3 == 0, i % 6 == 0, 0.25 + (i % 4) * 0.1


def q_gate_hindi(spark, sf):
    """The production gate on questions in both scripts, with the pre-check itself."""
    i = F.col("id")
    return table(spark, "id int, t string", rules.QUESTIONS).select("id", P.gate(F.trim("t"), *_signals(i)).alias("g")).select("id", "g.*")


def q_bake_off(spark, sf):
    """Character errors against the closest window, recall of numbers and of fractions: per page, then the mean of pages."""
    rows = table(spark, "method string, page int, prose array<string>, fractions array<string>, t string, seconds double", BAKED)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+/\d+|\d+)"), F.lit(1))
    lines = rows.select("method", "page", "t", F.explode("prose").alias("line")).withColumn("found", P.best_window(F.col("line"), F.col("t")))
    times = lambda a, n: F.size(F.filter(a, lambda x: x == n))
    lines = lines.withColumn("want", numbers(F.col("line"))).withColumn("got", numbers(F.col("found")))
    hits = F.aggregate(F.array_distinct("want"), F.lit(0), lambda s, n: s + F.least(times(F.col("want"), n), times(F.col("got"), n)))
    errors = lines.groupBy("method", "page").agg((F.sum(F.levenshtein("line", "found")) / F.sum(F.length("line"))).alias("cer"), (F.sum(hits) / F.nullif(F.sum(F.size("want")), F.lit(0))).alias("numeric"))
    fractions = rows.select("method", "page", "seconds", (F.size(F.filter("fractions", lambda x: F.col("t").contains(x))) / F.nullif(F.size("fractions"), F.lit(0))).alias("fraction"))
    mean = lambda c: F.round(F.avg(c), 6)
    return errors.join(fractions, ["method", "page"]).groupBy("method").agg(mean("cer").alias("cer"), mean("numeric").alias("numeric_recall"), mean("fraction").alias("fraction_recall"), mean("seconds").alias("seconds_a_page"))


def q_figure_dependent(spark, sf):
    rows = table(spark, "section int, page int, share double, words int", FIGURED)
    return rows.groupBy("section").agg(F.bool_or((F.col("share") >= SHARE) & (F.col("words") < WORDS)).alias("figure_dependent"))


def q_asides(spark, sf):
    """Each aside with the section that is current at the end of its page, or the last one before if the page has no line."""
    ends = table(spark, "book string, page int, line int, section int", BODY).groupBy("book", "page").agg(F.max_by("section", "line").alias("section"))
    asides = table(spark, "book string, page int, aside string", ASIDES)
    both = ends.select("book", "page", "section", F.lit(None).cast("string").alias("aside")).unionByName(asides.withColumn("section", F.lit(None).cast("int")))
    order = Window.partitionBy("book").orderBy("page", F.col("aside").isNotNull(), "aside")
    return both.withColumn("section", F.last("section", ignorenulls=True).over(order)).where("aside is not null").select("book", "page", "aside", "section")


def q_map_merge(spark, sf):
    """Two maps as one; the right one's values win."""
    rows = table(spark, "id int, ak array<string>, av array<string>, bk array<string>, bv array<string>", MERGED)
    left = F.map_filter(F.map_from_arrays("ak", "av"), lambda k, _: ~F.array_contains("bk", k))
    return rows.select("id", F.explode(F.map_concat(left, F.map_from_arrays("bk", "bv"))).alias("k", "v"))


def q_same_ranking(spark, sf):
    """Whether the first five chunks of a question stay the same when vectors are rounded to three digits."""
    questions, chunks = Q.tables(spark, sf)
    rough = lambda c: F.transform(c, lambda x: F.round(x.cast("double"), 3))

    def five(q, c, name):
        top = R.ranked(R.dense(q, c).withColumn("score", F.round("dense", 6)))
        return top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cid"))), lambda x: x["cid"]).alias(name))

    other = five(questions.withColumn("qv", rough("qv")), chunks.withColumn("cv", rough("cv")), "b")
    return five(questions, chunks, "a").join(other, "qid").select("qid", (F.col("a") == F.col("b")).alias("same"), F.size(F.array_intersect("a", "b")).alias("shared"))


def q_score_overlap(spark, sf):
    """Whether the top scores of answerable questions and of others overlap, and by how much."""
    top = F.col("top1")
    low, high = F.min(F.when(F.col("answerable"), top)), F.max(F.when(~F.col("answerable"), top))
    return Q.all_signals(spark, sf).agg(low.alias("answerable_low"), high.alias("other_high"), F.round(high - low, 6).alias("gap"), (high >= low).alias("overlap"))


def q_url_query(spark, sf):
    u = F.col("u")
    return table(spark, "id int, u string", URLS).select("id", F.parse_url(u, F.lit("QUERY"), F.lit("chapter")).alias("chapter"), F.parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"))


def q_partition(spark, sf):
    """The text around the first label sign, and its first token without punctuation."""
    t = F.col("t")
    there = F.instr(t, ": ")
    head = F.when(there > 0, F.substring(t, F.lit(1), there - 1)).otherwise(t)
    return table(spark, "id int, t string", LABELLED).select("id", head.alias("head"), F.when(there > 0, F.substring(t, there + 2, F.length(t))).otherwise("").alias("tail"), F.btrim(F.split_part(t, F.lit(" "), F.lit(1)), F.lit(PUNCTUATION)).alias("word"))


def q_base64(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    coded = items.withColumn("coded", F.translate(F.base64(F.col("text").cast("binary")), "\r\n", ""))
    return coded.select("item_id", "coded", (F.unbase64("coded").cast("string") == F.col("text")).alias("same"))


def running_ids(rows, key, width=4_096):
    """rows with rid, a running number by key (from 0): numbers within ranges of keys plus what ranges before hold, so that no task sorts all rows.

    Null keys come first; rows of one key get different numbers, in any order. An empty table stays empty."""
    rows = rows.withColumn("_range", F.floor(F.col(key) / width))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return rows.withColumn("rid", place).join(before, F.col("_range").eqNullSafe(F.col("_at"))).withColumn("rid", F.col("rid") + F.col("_before")).drop("_range", "_at", "_before")


def q_running_id(spark, sf):
    return running_ids(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), "doc_id").select("doc_id", "rid")


def q_result_cache(spark, sf):
    """Each turn with the first turn of the same normalised text, whose result would be reused."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.lower(F.trim("text")).alias("key"))
    first = rows.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("f"))
    return rows.join(first, "key").select("conv_id", "turn", F.col("f.conv_id").alias("first_conv"), F.col("f.turn").alias("first_turn"), ((F.col("f.conv_id") != F.col("conv_id")) | (F.col("f.turn") != F.col("turn"))).alias("reused"))


def q_minute_quota(spark, sf):
    """Requests and tokens of each minute against the quota; a token is a character of the request here."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.length("props").alias("tokens"))
    return rows.groupBy("minute").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), (F.sum("tokens") <= TOKENS_MINUTE).alias("allowed"))


def q_corpus_summary(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", F.length("text").alias("n"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n").alias("chars"), F.round(F.avg("n"), 4).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") >= 1_000).alias("long"))


def q_vocabulary(spark, sf):
    """Documents with a word that starts so: one pass for all words, no join and no text of the whole corpus."""
    text = F.lower("text")
    found = spark.read.parquet(f"{sf}/documents.parquet").agg(*(F.count_if(text.rlike(f"(?<![a-z]){w}")).alias(w) for w in VOCABULARY))
    return found.unpivot([], VOCABULARY, "word", "documents").withColumn("absent", F.col("documents") == 0)


def q_chapter_text(spark, sf):
    rows = table(spark, "chapter string, ord int, t string", LINES)
    return rows.groupBy("chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n").alias("whole"))


def q_failing_ids(spark, sf):
    return table(spark, "id int, failures array<string>", FAILED).where(F.exists("failures", lambda f: f.contains("not_") | f.startswith("missing"))).select("id")


_TOP5 = "select qid, list(cid order by round(dense, 6) desc, cid) as v from (select *, row_number() over (partition by qid order by round(dense, 6) desc, cid) as r from {}) where r <= 5 group by qid"
_ROUGH = "list_transform({}, lambda x: round(x::double, 3))"
_TIMES = "len(list_filter({}, lambda x: x = n))"

QUERIES = {
    "q_terms_hindi": (q_terms_hindi, f"with {sql('x', 'id, t', HINDI)}, v as (select id, regexp_extract_all(lower(t), '[ऀ-ॿ]+|[a-z]+|[0-9]+/[0-9]+|[0-9]+') as v from x) select id, unnest(v) as term, generate_subscripts(v, 1) - 1 as place from v"),
    "q_gate_hindi": (q_gate_hindi, f"""with p as ({rules.QUERIES['q_pre_check'][1]}), {sql('q', 'id, t', rules.QUESTIONS)},
        s as (select id, p.outcome, p.reason as why, regexp_matches(t, '(^|[^ऀ-ॿ])(कहाँ|कितने|कितना|कितनी|क्या|कौन)') and not regexp_matches(t, '(^|[^ऀ-ॿ])(कैसे|मतलब|क्यों|तरीका|विधि|समझा)') as seeking from q join p using (id)),
        d as (select id, case when outcome <> 'pass' then why when id % 5 * 0.03 >= 0.08 then 'out_of_syllabus_by_margin' when id % 7 = 0 then 'chunk_below_extraction_gate' when seeking and id % 6 = 0 then 'answer_is_in_a_chart' when id % 4 = 0 then 'below_similarity_floor' end as reason, outcome from s)
        select id, reason is not null as refuse, reason, case when outcome <> 'pass' then 'query_pre_check' when reason = 'out_of_syllabus_by_margin' then 'class_metadata' when reason = 'chunk_below_extraction_gate' then 'chunk_flag' when reason = 'answer_is_in_a_chart' then 'chart_axis' when reason = 'below_similarity_floor' then 'similarity' end as layer from d"""),
    "q_bake_off": (q_bake_off, f"""with {sql('x', 'method, page, prose, fractions, t, seconds', BAKED)}, l as (select method, page, t, unnest(prose) as line from x), w as (select method, page, line, substring(t, i::int, length(line)) as sub, i from (select *, unnest(range(1, greatest(1, length(t) - length(line) + 1) + 1)) as i from l)),
        b as (select method, page, line, arg_min(sub, (levenshtein(line, sub), i)) as found from w group by all), n as (select *, regexp_extract_all(line, '[0-9]+/[0-9]+|[0-9]+') as want, regexp_extract_all(found, '[0-9]+/[0-9]+|[0-9]+') as got from b),
        e as (select method, page, sum(levenshtein(line, found)) / sum(length(line)) as cer, sum(coalesce(list_sum(list_transform(list_distinct(want), lambda n: least({_TIMES.format('want')}, {_TIMES.format('got')}))), 0)) / nullif(sum(len(want)), 0) as num from n group by all),
        f as (select method, page, seconds, len(list_filter(fractions, lambda f: contains(t, f::varchar))) / nullif(len(fractions), 0) as frac from x)
        select method, round(avg(cer), 6) as cer, round(avg(num), 6) as numeric_recall, round(avg(frac), 6) as fraction_recall, round(avg(seconds), 6) as seconds_a_page from e join f using (method, page) group by method"""),
    "q_figure_dependent": (q_figure_dependent, f"with {sql('x', 'section, page, share, words', FIGURED)} select section, count(*) filter (share >= 0.34 and words < 90) > 0 as figure_dependent from x group by section"),
    "q_asides": (q_asides, f"with {sql('b', 'book, page, line, section', BODY)}, {sql('a', 'book, page, aside', ASIDES)}, e as (select book, page, arg_max(section, line) as section from b group by all) select a.book, a.page, a.aside, e.section from a asof left join e on a.book = e.book and a.page >= e.page"),
    "q_map_merge": (q_map_merge, f"with {sql('x', 'id, ak, av, bk, bv', MERGED)}, u as (select id, unnest(ak)::varchar as k, unnest(av)::varchar as v, 0 as side from x union all select id, unnest(bk)::varchar, unnest(bv)::varchar, 1 from x) select id, k, arg_max(v, side) as v from u group by id, k"),
    "q_same_ranking": (q_same_ranking, f"with {Q.BASE}, rough as (select qid, cid, list_dot_product({_ROUGH.format('qv')}, {_ROUGH.format('cv')}) as dense from q cross join c), a as ({_TOP5.format('pairs')}), b as ({_TOP5.format('rough')}) select qid, a.v = b.v as same, len(list_intersect(a.v, b.v)) as shared from a join b using (qid)"),
    "q_score_overlap": (q_score_overlap, f"with {Q.SIGNALS}, o as (select min(top1) filter (answerable) as answerable_low, max(top1) filter (not answerable) as other_high from sig) select *, round(other_high - answerable_low, 6) as gap, other_high >= answerable_low as overlap from o"),
    "q_url_query": (q_url_query, f"with {sql('x', 'id, u', URLS)}, s as (select id, split_part(u, '#', 1) as u from x) select id, nullif(regexp_extract(u, '[?&]chapter=([^&]*)', 1), '') as chapter, nullif(regexp_extract(u, '[?&]page=([^&]*)', 1), '') as page from s"),
    "q_partition": (q_partition, f"with {sql('x', 'id, t', LABELLED)} select id, split_part(t, ': ', 1) as head, case when contains(t, ': ') then substring(t, position(': ' in t) + 2) else '' end as tail, trim(split_part(t, ' ', 1), '{PUNCTUATION.replace(chr(39), chr(39) * 2)}') as word from x"),
    "q_base64": (q_base64, "select item_id, to_base64(encode(text)) as coded, true as same from benchmark"),
    "q_running_id": (q_running_id, "select doc_id, row_number() over (order by doc_id) - 1 as rid from documents"),
    "q_result_cache": (q_result_cache, "with r as (select conv_id, turn, lower(trim(text)) as key from conversations), f as (select key, min((conv_id, turn)) as f from r group by key) select conv_id, turn, f[1] as first_conv, f[2] as first_turn, f <> (conv_id, turn) as reused from r join f using (key)"),
    "q_minute_quota": (q_minute_quota, "select strftime(ts, '%Y-%m-%d %H:%M') as minute, count(*) as requests, sum(length(props)) as tokens, sum(length(props)) <= 8000 as allowed from events group by 1"),
    "q_corpus_summary": (q_corpus_summary, "select lang, count(*) as documents, count(distinct source) as sources, sum(length(text)) as chars, round(avg(length(text)), 4) as mean, min(length(text)) as least, max(length(text)) as most, count(*) filter (length(text) >= 1000) as long from documents group by lang"),
    "q_vocabulary": (q_vocabulary, " union all ".join(f"select '{w}' as word, n as documents, n = 0 as absent from (select count(*) as n from documents where regexp_matches(lower(text), '(^|[^a-z]){w}'))" for w in VOCABULARY)),
    "q_chapter_text": (q_chapter_text, f"with {sql('x', 'chapter, ord, t', LINES)} select chapter, string_agg(t, chr(10) order by ord) as whole from x group by chapter"),
    "q_failing_ids": (q_failing_ids, f"with {sql('x', 'id, f', FAILED)}, u as (select id, unnest(f)::varchar as f from x) select distinct id from u where contains(f, 'not_') or starts_with(f, 'missing')"),
}
