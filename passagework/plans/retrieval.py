"""Retrieval, gate and calibration queries over documents (chunks), benchmark (questions) and embeddings (vectors).

A chunk is a document with a vector, a question a benchmark item with one; label parity stands for the
syllabus; other flags come from the text, as the tables have no page structure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions.lexicon import STOPWORDS
from passagework.operators import retrieval as R

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


#: Ids of vectors up to which they are broadcast, to drop other documents before texts are read further.
IDS = 4_000_000


def tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Questions and chunks. What is taken from a text is taken before the join, so that texts are dealt out only to queries that return parts of them."""
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    vectors = read("embeddings")
    items = read("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))
    questions = items.join(vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.col("label").alias("qlabel")), "qid")
    chunks = read("documents").join(items.select(F.col("qid").alias("doc_id")), "doc_id", "left_anti")
    if vectors.count() <= IDS:
        chunks = chunks.join(F.broadcast(vectors.select(F.col("vec_id").alias("doc_id"))), "doc_id", "left_semi")
    text = F.col("text")
    chunks = chunks.select(
        "doc_id", "text", "lang", "n_chars", R.asked_terms(text, items).alias("asked"), text.contains(" | ").alias("chart_axis"), text.rlike("[0-9]").alias("has_numbers"),
        F.regexp_count(text, F.lit("ti")).alias("outside_hits"), F.regexp_count(text, F.lit("the")).alias("inside_hits"),
    )
    return questions, chunks.join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id").withColumnsRenamed({"doc_id": "cid", "embedding": "cv"})


def flags(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"in_syllabus": F.col("label") % 2 == 0, "needs_review": F.col("n_chars") < 200, "figure": F.col("n_chars") < 400})


def checks(questions: DataFrame) -> DataFrame:
    text = F.col("qtext")
    return questions.select("qid", "qlabel", (F.col("qlabel") % 2 == 0).alias("answerable"), (F.size(T.tokens(text)) >= 20).alias("passed"), text.contains("in").alias("seeking"), text.contains("ationer").alias("beyond"))


BASE = f"""q as (select b.item_id as qid, b.text as qtext, e.embedding as qv, e.label as qlabel from benchmark b join embeddings e on e.vec_id = b.item_id),
c as (select d.doc_id as cid, d.text, d.lang, d.n_chars, e.embedding as cv, e.label from documents d join embeddings e on e.vec_id = d.doc_id where d.doc_id not in (select item_id from benchmark)),
posts as (select distinct cid, unnest(regexp_extract_all(lower(text), '[ऀ-ॿ]+|[\\p{{L}}\\p{{M}}]+|\\d+/\\d+|\\d+')) as term from c),
n as (select greatest(count(*), 1) as n from c),
idf as (select term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from (select term, count(*) as df from posts group by term), n),
qt as (select distinct qid, term from (select qid, unnest(regexp_extract_all(lower(qtext), '[ऀ-ॿ]+|[\\p{{L}}\\p{{M}}]+|\\d+/\\d+|\\d+')) as term from q) where term not in ({STOP})),
qw as (select qid, term, coalesce(idf, ln(1.0 + n)) as w, idf is not null as known from qt left join idf using (term), n),
lex as (select qid, cid, sum(w) / any_value(total) as lex from (select *, sum(w) over (partition by qid) as total from qw) join posts using (term) group by qid, cid),
pairs as (select qid, cid, list_dot_product(qv::double[], cv::double[]) as dense, coalesce(lex, 0) as lex from q cross join c left join lex using (qid, cid)),
s as (select *, round(dense + 0.35 * lex, 6) as score from pairs),
ranked as (select *, row_number() over (partition by qid order by score desc, cid) as rank from s),
f as (select cid, label, label % 2 = 0 as in_syllabus, n_chars < 200 as needs_review, contains(text, ' | ') as chart_axis, regexp_matches(text, '[0-9]') as has_numbers, n_chars < 400 as figure,
      len(regexp_extract_all(text, 'ti')) as outside_hits, len(regexp_extract_all(text, 'the')) as inside_hits from c),
k as (select qid, qlabel, qlabel % 2 = 0 as answerable, len(list_filter(regexp_split_to_array(qtext, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) >= 20 as passed, contains(qtext, 'in') as seeking, contains(qtext, 'ationer') as beyond from q)"""

SIGNALS = f"""{BASE},
p as (select * from s join f using (cid)),
best as (select qid, max(score) as top1, arg_max(struct_pack(in_syllabus, needs_review, chart_axis, has_numbers, figure), (score, -cid)) as t,
  coalesce(max(score) filter (in_syllabus), 0) as best_in, arg_max(struct_pack(cid, needs_review, chart_axis), (score, -cid)) filter (in_syllabus) as b, greatest(coalesce(max(score) filter (not in_syllabus), 0), 0) as best_out,
  {', '.join(f"coalesce(max(score) filter (not in_syllabus and outside_hits >= {h} and outside_hits >= inside_hits * {r}), 0) as decoy_{i}" for i, (h, r) in enumerate(R.DECOYS))}
  from p group by qid),
sig as (select best.*, fifth, round(best_out - best_in, 6) as lead, round(top1 - fifth, 6) as margin, k.* exclude (qid) from best join (select qid, min(score) as fifth from ranked where rank <= 5 group by qid) using (qid) join k using (qid))"""


def all_signals(spark, sf) -> DataFrame:
    questions, chunks = tables(spark, sf)
    pairs = R.scored(questions, R.kinds(flags(chunks)), carry=R.CARRIED, best=R.SIGNALS)
    return R.signals(pairs).join(F.broadcast(checks(questions)), "qid")


def best_scored(questions: DataFrame, chunks: DataFrame, top: int = R.TOP) -> DataFrame:
    """The first chunks of each question, with rank."""
    return R.ranked(R.scored(questions, chunks, best=[(None, top)]), top)


def q_idf(spark, sf):
    _, chunks = tables(spark, sf)
    return R.idf(R.postings(chunks), chunks).select("term", "df", F.round("idf", 6).alias("idf"))


def q_lexical_score(spark, sf):
    return R.lexical(*tables(spark, sf)).select("qid", "cid", F.round("lex", 6).alias("lex"))


def q_dense_topk(spark, sf):
    pairs = R.dense(*tables(spark, sf)).withColumn("score", F.round("dense", 6))
    return R.ranked(pairs).select("qid", "rank", "cid", "score")


def q_hybrid_topk(spark, sf):
    return best_scored(*tables(spark, sf)).select("qid", "rank", "cid", "score")


def q_margin(spark, sf):
    top = best_scored(*tables(spark, sf))
    return top.groupBy("qid").agg(F.max("score").alias("top1"), F.min("score").alias("top5"), F.round(F.max("score") - F.min("score"), 6).alias("margin"))


def q_best_per_corpus(spark, sf):
    return all_signals(spark, sf).select("qid", "best_in", F.col("b.cid").alias("best_in_cid"), "best_out", "lead")


def q_gate(spark, sf):
    """The layered decision: pre-check, lead of other books, review flag, answer in a chart, similarity floor."""
    rows = all_signals(spark, sf)
    reason = F.when(~F.col("passed"), "too_short").when(F.col("beyond"), "beyond_topic").when(F.col("lead") >= R.MARGIN, "out_of_syllabus_by_margin").when(F.col("b.needs_review"), "chunk_below_extraction_gate")
    reason = reason.when(F.col("seeking") & F.col("b.chart_axis") & F.coalesce("all_chart", F.lit(True)), "answer_is_in_a_chart").when(F.col("best_in") < R.FLOOR, "below_similarity_floor")
    layers = F.create_map(*(F.lit(x) for x in ("too_short", "query_pre_check", "beyond_topic", "query_vocabulary", "out_of_syllabus_by_margin", "class_metadata", "chunk_below_extraction_gate", "chunk_flag", "answer_is_in_a_chart", "chart_axis", "below_similarity_floor", "similarity")))
    return rows.select("qid", reason.isNotNull().alias("refuse"), reason.alias("reason"), layers[reason].alias("layer"), "best_in", "best_out")


def q_decoy_density(spark, sf):
    return all_signals(spark, sf).select("qid", *(f"decoy_{i}" for i in range(len(R.DECOYS))))


def q_sweep(spark, sf):
    return R.sweep(all_signals(spark, sf))


def q_operating_point(spark, sf):
    return R.operating_points(R.sweep(all_signals(spark, sf)), 0.4)


def q_score_separation(spark, sf):
    rows = all_signals(spark, sf)
    return rows.groupBy("answerable").agg(F.count(F.lit(1)).alias("n"), F.min("top1").alias("low"), F.round(F.avg("top1"), 6).alias("mean"), F.max("top1").alias("high"))


def relevant(spark, sf) -> DataFrame:
    """Full ranking with whether the chunk has the question's label."""
    questions, chunks = tables(spark, sf)
    pairs = R.scored(questions, chunks, carry=("label",)).join(F.broadcast(questions.select("qid", "qlabel")), "qid")
    return R.ranked(pairs, None).withColumn("hit", F.col("qlabel") == F.col("label"))


def q_needle_rank(spark, sf):
    return relevant(spark, sf).groupBy("qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"), F.count_if("hit").alias("relevant"))


def q_hit_at_k(spark, sf):
    first = q_needle_rank(spark, sf)
    share = lambda k: F.round(F.avg((F.coalesce("first_rank", F.lit(10**9)) <= k).cast("double")), 6)
    return first.agg(F.count(F.lit(1)).alias("n"), share(1).alias("hit_1"), share(5).alias("hit_5"), (share(5) >= 0.9).alias("passes"))


def q_coverage_at_k(spark, sf):
    first = q_needle_rank(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, (3, 4, 5, 6, 8)))))
    return first.groupBy("k").agg(F.count_if(F.col("first_rank") <= F.col("k")).alias("covered"), F.count(F.lit(1)).alias("n"))


def key_terms(questions, chunks) -> DataFrame:
    """The two rarest terms over two letters of each question, unseen ones first."""
    order = Window.partitionBy("qid").orderBy(F.round("v", 6).desc(), "term")
    w = R.weighted(questions, chunks).where("length(term) > 2").withColumn("v", F.when(F.col("known"), F.col("w")).otherwise(99.0))
    return w.withColumn("n", F.row_number().over(order)).where("n <= 2").select("qid", "n", "term", F.round("v", 6).alias("weight"))


def q_key_terms(spark, sf):
    return key_terms(*tables(spark, sf))


def q_relevance_by_weight(spark, sf):
    """Share of questions with one of their key terms in the text of their first three chunks, by lexical weight."""
    questions, chunks = tables(spark, sf)
    values = (0.0, 0.2, 0.35, 0.5, 0.8)
    weights = F.explode(F.array(*map(F.lit, values))).alias("weight")
    pairs = R.scored(questions, chunks, best=[(None, R.CONTEXT)], weights=values).select("qid", "cid", "dense", "lex", weights).withColumn("score", F.round(F.col("dense") + F.col("weight") * F.col("lex"), 6))
    first = Window.partitionBy("qid", "weight").orderBy(F.col("score").desc(), "cid")
    top = pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= R.CONTEXT).select("qid", "weight", "cid")
    key = key_terms(questions, chunks).groupBy("qid").agg(F.collect_list("term").alias("terms"))
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("cid"), "text").join(F.broadcast(top), "cid")  # three chunks a question and weight
    met = texts.join(F.broadcast(key), "qid", "left").select("qid", "weight", F.coalesce(F.arrays_overlap(T.terms(F.col("text")), "terms"), F.lit(False)).alias("met"))
    each = met.groupBy("qid", "weight").agg(F.max("met").alias("met"))
    return each.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), F.count_if("met").alias("relevant"), F.round(F.count_if("met") / F.count(F.lit(1)), 6).alias("share"))


def q_terms_lost(spark, sf):
    """Question terms that the first three chunks have, but not within the first 900 characters of any."""
    questions, chunks = tables(spark, sf)
    top = best_scored(questions, chunks, R.CONTEXT).select("qid", "cid")
    asked = R.question_terms(questions).select("qid", "term")
    texts = top.join(chunks.select("cid", "text"), "cid")
    have = lambda text: texts.select("qid", F.explode(F.array_distinct(T.terms(text))).alias("term")).distinct().join(asked, ["qid", "term"], "left_semi")
    whole, cut = have(F.col("text")), have(F.substring("text", 1, R.CONTEXT_CHARS))
    lost = whole.join(cut, ["qid", "term"], "left_anti").groupBy("qid").agg(F.count(F.lit(1)).alias("lost"), F.concat_ws(" ", F.array_sort(F.collect_list("term"))).alias("terms"))
    return questions.select("qid").join(lost, "qid", "left").select("qid", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("terms", F.lit("")).alias("terms"))


def q_answerability(spark, sf):
    """Share of a question's known terms that its own label's chunks have, per label, as number and bar."""
    questions, chunks = tables(spark, sf)
    terms = R.weighted(questions, chunks).where("known").select("qid", "term").join(questions.select("qid", "qlabel"), "qid")
    own = R.postings(chunks).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").join(chunks.select("cid", "label"), "cid").select("label", "term").distinct().withColumn("there", F.lit(1))
    met = terms.join(own.withColumnRenamed("label", "qlabel"), ["qlabel", "term"], "left")
    share = F.avg(F.coalesce("there", F.lit(0)).cast("double"))
    return met.groupBy("qlabel").agg(F.countDistinct("qid").alias("questions"), F.round(share, 6).alias("share"), F.repeat(F.lit("#"), F.floor(share * 10 + 0.5).cast("int")).alias("bar"))


def q_context(spark, sf):
    """The prompt's context: the first three chunks of the syllabus, cut to 900 characters, in order of rank."""
    questions, chunks = tables(spark, sf)
    pairs = R.scored(questions, flags(chunks), carry=("in_syllabus",), best=[("in_syllabus", R.CONTEXT)])
    top = R.ranked(pairs.where("in_syllabus"), R.CONTEXT).select("qid", "cid", "rank").join(chunks.select("cid", "text", "lang", "label"), "cid")
    part = F.concat(F.lit("["), F.col("lang"), F.lit(" "), F.col("label").cast("string"), F.lit("]\n"), F.substring("text", 1, R.CONTEXT_CHARS))
    return top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n\n---\n\n").alias("context"))


def q_embed_parity(spark, sf):
    """Vectors against a copy rounded to three digits: least cosine, and whether each pair reaches 0.999."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("a"))
    b = v.select("vec_id", F.transform("a", lambda x: F.round(x.cast("double"), 3)).alias("b"))
    both = v.join(b, "vec_id").select((T.dot(F.col("a"), F.col("b")) / F.sqrt(T.dot(F.col("a"), F.col("a")) * T.dot(F.col("b"), F.col("b")))).alias("cosine"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("cosine"), 6).alias("worst"), F.every(F.col("cosine") >= 0.999).alias("same"))


_CONTEXT_TOP = "ctx as (select qid, bool_and(chart_axis) as all_chart from (select *, row_number() over (partition by qid order by score desc, cid) as r from p where in_syllabus) where r <= 3 group by qid)"
_FLAGS = "not t.needs_review and not (seeking and t.chart_axis) and not (seeking and not t.has_numbers)"
_RULES = {
    "similarity_only": "top1 >= th", "similarity_and_class5": "top1 >= th and t.in_syllabus", "class5_only": "t.in_syllabus", "similarity_class5_and_margin": "top1 >= th and t.in_syllabus and margin >= 0.03",
    "production": "top1 >= th and t.in_syllabus and not t.figure and not t.needs_review", "layered": "passed and t.in_syllabus and not t.needs_review and top1 >= th", "layered_plus_numeric": f"passed and t.in_syllabus and {_FLAGS} and top1 >= th",
    "topic_first": f"passed and not beyond and {_FLAGS} and best_in >= th",
    **{f"topic+decoy_{g:g}": f"passed and not beyond and lead < {g} and {_FLAGS} and best_in >= th" for g in (0.01, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25)},
    **{f"decoy_{h}_{r:g}": f"passed and best_in >= decoy_{i} and {_FLAGS} and best_in >= th" for i, (h, r) in enumerate(R.DECOYS)},
    **{f"margin_{g:g}": f"passed and lead < {g} and {_FLAGS} and greatest(best_in, 0) >= th" for g in (0.07, 0.08, 0.09, 0.10, 0.12, 0.15, 0.20, 0.30)},
}
SWEEP = f"""{SIGNALS}, m as (select unnest(range(300, 780, 5)) as mills), sm as (select sig.*, mills, mills / 1000.0 as th from sig, m),
tried as ({' union all '.join(f"select '{name}' as design, {'0 as mills' if name == 'class5_only' else 'mills'}, answerable, {rule} as accepted from sm{' where mills = 300' if name == 'class5_only' else ''}" for name, rule in _RULES.items())}),
curve as (select design, mills / 1000.0 as threshold, round(count(*) filter (accepted and answerable) / greatest(count(*) filter (answerable), 1), 4) as coverage, round(count(*) filter (accepted and not answerable) / greatest(count(*) filter (accepted), 1), 4) as wrong_rate,
  count(*) filter (accepted) as answered, round(1 - count(*) filter (accepted) / count(*), 4) as refusal_rate from tried group by design, mills)"""
_REL = f"{BASE}, rel as (select r.*, qlabel = label as hit from ranked r join q using (qid) join c using (cid)), first as (select qid, min(rank) filter (hit) as first_rank, count(*) filter (hit) as relevant from rel group by qid)"
_KEY = f"{BASE}, v as (select qid, term, round(case when known then w else 99 end, 6) as weight from qw where length(term) > 2), key as (select * from (select qid, row_number() over (partition by qid order by weight desc, term) as n, term, weight from v) where n <= 2)"
_TERMS = "regexp_extract_all(lower({}), '[ऀ-ॿ]+|[\\p{{L}}\\p{{M}}]+|\\d+/\\d+|\\d+')"

QUERIES = {
    "q_idf": (q_idf, f"with {BASE} select term, df, round(idf, 6) as idf from idf"),
    "q_lexical_score": (q_lexical_score, f"with {BASE} select qid, cid, round(lex, 6) as lex from lex"),
    "q_dense_topk": (q_dense_topk, f"with {BASE} select * from (select qid, row_number() over (partition by qid order by round(dense, 6) desc, cid) as rank, cid, round(dense, 6) as score from pairs) where rank <= 5"),
    "q_hybrid_topk": (q_hybrid_topk, f"with {BASE} select qid, rank, cid, score from ranked where rank <= 5"),
    "q_margin": (q_margin, f"with {BASE} select qid, max(score) as top1, min(score) as top5, round(max(score) - min(score), 6) as margin from ranked where rank <= 5 group by qid"),
    "q_best_per_corpus": (q_best_per_corpus, f"with {SIGNALS} select qid, best_in, b.cid as best_in_cid, best_out, lead from sig"),
    "q_gate": (q_gate, f"""with {SIGNALS}, {_CONTEXT_TOP}, d as (select *, case when not passed then 'too_short' when beyond then 'beyond_topic' when lead >= 0.08 then 'out_of_syllabus_by_margin' when b.needs_review then 'chunk_below_extraction_gate'
        when seeking and b.chart_axis and coalesce(all_chart, true) then 'answer_is_in_a_chart' when best_in < 0.3 then 'below_similarity_floor' end as reason from sig left join ctx using (qid))
        select qid, reason is not null as refuse, reason, case reason when 'too_short' then 'query_pre_check' when 'beyond_topic' then 'query_vocabulary' when 'out_of_syllabus_by_margin' then 'class_metadata' when 'chunk_below_extraction_gate' then 'chunk_flag'
        when 'answer_is_in_a_chart' then 'chart_axis' when 'below_similarity_floor' then 'similarity' end as layer, best_in, best_out from d"""),
    "q_decoy_density": (q_decoy_density, f"with {SIGNALS} select qid, decoy_0, decoy_1, decoy_2, decoy_3, decoy_4, decoy_5 from sig"),
    "q_sweep": (q_sweep, f"with {SWEEP} select * from curve"),
    "q_operating_point": (q_operating_point, f"with {SWEEP}, o as (select *, row_number() over (partition by design order by coverage desc, threshold) as n from curve where wrong_rate <= 0.4) select design, o.threshold, o.coverage, o.wrong_rate from (select distinct design from curve) left join (select * from o where n = 1) o using (design)"),
    "q_score_separation": (q_score_separation, f"with {SIGNALS} select answerable, count(*) as n, min(top1) as low, round(avg(top1), 6) as mean, max(top1) as high from sig group by answerable"),
    "q_needle_rank": (q_needle_rank, f"with {_REL} select * from first"),
    "q_hit_at_k": (q_hit_at_k, f"with {_REL}, h as (select count(*) as n, round(avg((coalesce(first_rank, 1000000000) <= 1)::int), 6) as hit_1, round(avg((coalesce(first_rank, 1000000000) <= 5)::int), 6) as hit_5 from first) select *, hit_5 >= 0.9 as passes from h"),
    "q_coverage_at_k": (q_coverage_at_k, f"with {_REL} select k, count(*) filter (first_rank <= k) as covered, count(*) as n from first, (select unnest([3, 4, 5, 6, 8]) as k) group by k"),
    "q_key_terms": (q_key_terms, f"with {_KEY} select qid, n, term, weight from key"),
    "q_relevance_by_weight": (q_relevance_by_weight, f"""with {_KEY}, w5 as (select unnest([0.0, 0.2, 0.35, 0.5, 0.8])::double as weight), top as (select * from (select qid, w5.weight, cid, row_number() over (partition by qid, w5.weight order by round(dense + w5.weight * lex, 6) desc, cid) as r from pairs, w5) where r <= 3),
        hit as (select weight, count(distinct qid) as relevant from (select top.weight, top.qid from top join posts using (cid) join key on key.qid = top.qid and key.term = posts.term) group by weight)
        select weight, n, coalesce(relevant, 0) as relevant, round(coalesce(relevant, 0) / n, 6) as share from (select weight, count(distinct qid) as n from top group by weight) left join hit using (weight)"""),
    "q_terms_lost": (q_terms_lost, f"""with {BASE}, t3 as (select qid, text from ranked join c using (cid) where rank <= 3), whole as (select distinct qid, unnest({_TERMS.format('text')}) as term from t3), cut as (select distinct qid, unnest({_TERMS.format('substring(text, 1, 900)')}) as term from t3),
        lost as (select qid, term from whole join qt using (qid, term) except select qid, term from cut) select qid, count(term) as lost, coalesce(string_agg(term, ' ' order by term), '') as terms from q left join lost using (qid) group by qid"""),
    "q_answerability": (q_answerability, f"""with {BASE}, own as (select distinct label, term from posts join c using (cid)), met as (select q.qid, q.qlabel, own.term is not null as there from qw join q using (qid) left join own on own.label = q.qlabel and own.term = qw.term where known)
        select qlabel, count(distinct qid) as questions, round(avg(there::int), 6) as share, repeat('#', floor(avg(there::int) * 10 + 0.5)::int) as bar from met group by qlabel"""),
    "q_context": (q_context, f"""with {SIGNALS}, top as (select *, row_number() over (partition by qid order by score desc, cid) as r from p where in_syllabus)
        select qid, string_agg('[' || lang || ' ' || c.label || ']' || chr(10) || substring(text, 1, 900), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by r) as context from top join c using (cid) where r <= 3 group by qid"""),
    "q_embed_parity": (q_embed_parity, "with v as (select embedding::double[] as a, list_transform(embedding, lambda x: round(x::double, 3)) as b from embeddings), k as (select list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) as cosine from v) select count(*) as n, round(min(cosine), 6) as worst, bool_and(cosine >= 0.999) as same from k"),
}
