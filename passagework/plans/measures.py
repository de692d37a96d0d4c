"""Evaluation, cost, session and feed queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import metrics as M
from passagework.plans.values import sql, table
from passagework.streaming import feeds

MANIFEST = [(1, 1, 16, 16, True), (2, 17, 30, 14, True), (3, 31, 44, 13, True), (None, 180, 190, 11, False)]
RUNS = [(i, i % 7 != 0, i % 5 == 0, None if i == 3 else 1.0 + (i * 37 % 23) / 4, ["gate:too_short"] if i % 14 == 0 else ["too_long", "not_hindi"] if i % 7 == 0 else [], i % 4 + 1, i % 4 + 1 if i % 3 else 9) for i in range(1, 31)]
SCREENS = [(i, [True, True, i != 3, True], "B" if i % 3 else "A", i % 4 != 0) for i in range(1, 11)]
CHECKS = [("disk", "ok"), ("key", "warn"), ("index", "ok"), ("pages", "fail"), ("map", "ok")]
#: Fixed values of the cost model: tokens of a prompt and of a completion, share of the fixed prefix, rates per million in USD, rupees per USD, discounts.
PROMPT, COMPLETION, PREFIX, IN_RATE, OUT_RATE, RUPEES, CACHED, BATCHED = 1832, 380.5, 0.43, 0.29, 0.59, 85.5, 0.5, 0.5
TOTAL, QUESTIONS_WEEK = 2212.5, 4
QUOTAS = [("tokens per day", 200_000.0 / TOTAL / (QUESTIONS_WEEK / 7)), ("requests per day", 1000.0 / (QUESTIONS_WEEK / 7)), ("tokens per minute", None), ("events per month", 1e6 / (8 * QUESTIONS_WEEK * 4.3)), ("database", 500e6 / 1200 / (QUESTIONS_WEEK / 7 * 30 * 12))]
SCALES = [("pilot", 25), ("school", 300), ("district", 50_000), ("state", 10_000_000)]


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def q_nearest_rank_quantile(spark, sf):
    return M.nearest_rank(_read(spark, sf, "events"), ["event_type"], "value", [0.25, 0.5, 0.95])


def q_value_counts(spark, sf):
    return _read(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def q_hist_topn(spark, sf):
    """The 14 commonest words of the questions, ties by first occurrence."""
    words = _read(spark, sf, "benchmark").select("item_id", F.posexplode(T.tokens(F.lower("text"))).alias("at", "word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("item_id", "at")).alias("first"))
    return counts.orderBy(F.col("n").desc(), "first").limit(14).select("word", "n")


def q_bag_match(spark, sf):
    want = _read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.explode(T.tokens(F.lower("text"))).alias("word"))
    have = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(T.tokens(F.lower("text"))).alias("word"))
    return M.bag_matches(want, have.join(F.broadcast(want.select("id").distinct()), "id", "left_semi"), "id", "word")


def q_cer(spark, sf):
    """Character error rate of a damaged copy, per label of the item's number: sum of distances over sum of lengths, and the mean over items."""
    rows = _read(spark, sf, "benchmark").select((F.col("item_id") % 4).alias("page"), F.levenshtein("text", F.regexp_replace(F.regexp_replace("text", "th", "h"), "ea", "")).alias("d"), F.length("text").alias("n"))
    return rows.groupBy("page").agg(F.round(F.sum("d") / F.sum("n"), 6).alias("cer"), F.round(F.avg(F.col("d") / F.col("n")), 6).alias("mean_cer"), F.round(M.weighted_mean(F.col("d") / F.col("n"), F.col("n")), 6).alias("weighted"))


def q_generation_report(spark, sf):
    """Conformance of a run: answered, refused by the gate, contract failures, retries, right chapter, latency."""
    rows = table(spark, "id int, answered boolean, retried boolean, seconds double, failures array<string>, expected int, cited int", RUNS)
    q = M.nearest_rank(rows.withColumn("run", F.lit(1)), ["run"], "seconds", [0.5, 0.95])
    gated = F.exists("failures", lambda c: c.startswith("gate:"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("answered").alias("ok"), F.count_if(gated).alias("gated"), F.count_if("retried").alias("retried"), F.count_if(F.col("answered") & (F.col("expected") == F.col("cited"))).alias("right"))
    return out.join(q.select("q_50", "q_95")).select("n", "ok", "gated", (F.col("n") - F.col("ok") - F.col("gated")).alias("failed"), "retried", F.round(F.col("right") / F.col("ok"), 6).alias("precision"), F.col("q_50").alias("median"), F.col("q_95").alias("p95"))


def q_failure_codes(spark, sf):
    rows = table(spark, "id int, answered boolean, retried boolean, seconds double, failures array<string>, expected int, cited int", RUNS)
    return rows.select(F.explode("failures").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def costs() -> dict[str, float]:
    """Rupees per conversation: on demand, with the fixed prefix cached, batched, and both on the whole prompt."""
    usd = lambda prompt, rest: (prompt * IN_RATE + rest * OUT_RATE) / 1e6
    base = usd(PROMPT, COMPLETION)
    return {"on_demand": base * RUPEES, "cached": usd(PROMPT * PREFIX * (1 - CACHED) + PROMPT * (1 - PREFIX), COMPLETION) * RUPEES, "batched": base * (1 - BATCHED) * RUPEES, "both": base * (1 - BATCHED) * (1 - CACHED) * RUPEES}


def q_cost_model(spark, sf):
    scales = table(spark, "scale string, parents bigint", SCALES)
    month = F.col("parents") * QUESTIONS_WEEK * 4.3
    return scales.select("scale", *(F.round(month * c, 2).alias(k) for k, c in costs().items()), M.units(month * costs()["on_demand"]).alias("shown"))


def q_break_even(spark, sf):
    """Active parents at which each quota binds, bursts last."""
    rows = table(spark, "quota string, parents double", QUOTAS)
    order = Window.orderBy(F.col("parents").asc_nulls_last(), "quota")
    return rows.select("quota", F.floor("parents").alias("parents"), F.row_number().over(order).alias("place"))


def q_window_cost(spark, sf):
    """Answers a day by width of the context, tokens being calibrated on the widest questions' characters."""
    windows = F.explode(F.array(*map(F.lit, (900, 1100, 1300, 1550)))).alias("w")
    rows = _read(spark, sf, "benchmark").join(_read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("passage")), "item_id")
    chars = rows.select(windows, F.length("text").alias("q"), F.length("passage").alias("p")).groupBy("w").agg(F.avg(F.col("q") + F.least("p", "w")).alias("chars"))
    base = F.max(F.when(F.col("w") == 900, F.col("chars"))).over(Window.partitionBy(F.lit(1)))
    total = F.col("chars") / (base / PROMPT) + COMPLETION
    return chars.select("w", F.round("chars", 4).alias("chars"), F.round(total, 4).alias("tokens"), F.floor(200_000 / total).alias("answers"))


def q_session_last3(spark, sf):
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = _read(spark, sf, "conversations").where("role = 'user'").withColumn("r", F.row_number().over(order)).where("r <= 3")
    return rows.select("conv_id", "turn", F.substring("text", 1, 80).alias("asked"))


def q_running_feedback(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _read(spark, sf, "events").where("event_type in ('click', 'purchase')")
    return rows.select("event_id", F.sum((F.col("event_type") == "purchase").cast("int")).over(order).alias("explained"))


def q_dedup_ttl(spark, sf):
    rows = _read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return M.deduplicated(rows, "user_id", "ts", 6 * 3600).select("user_id", F.unix_micros("ts").alias("us"))


def q_manifest_gaps(spark, sf):
    """Sections whose pages do not reach to the next one's start; the last is bounded by page 191."""
    rows = table(spark, "chapter int, first int, last int, pages int, used boolean", MANIFEST)
    gap = F.coalesce(F.lead("first").over(Window.orderBy("first")), F.lit(191)) - F.col("first")
    return rows.select("chapter", "first", "pages", gap.alias("expected")).where("pages <> expected")


def q_range_join(spark, sf):
    """Page to section by range, ranges being disjoint: expanded to pages, then joined on equality."""
    pages = table(spark, "chapter int, first int, last int, pages int, used boolean", MANIFEST).where("used").select("chapter", "first", F.explode(F.sequence("first", "last")).alias("page"))
    asked = _read(spark, sf, "benchmark").select("item_id", (F.col("item_id") + 1).alias("page"))
    return asked.join(F.broadcast(pages), "page").select("item_id", "chapter", (F.col("page") - F.col("first")).alias("at"))


def q_stratified_sample(spark, sf):
    return M.round_robin(_read(spark, sf, "documents"), "source", "doc_id", 50).select("doc_id", "source", "turn")


def q_preflight_counts(spark, sf):
    return table(spark, "name string, state string", CHECKS).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def q_interview_rule(spark, sf):
    """Decisions from the first eight screened interviews: under five choices of B rescope, under six honest answers revisit."""
    rows = table(spark, "id int, screen array<boolean>, choice string, honest boolean", SCREENS).where(F.forall("screen", lambda x: x)).orderBy("id").limit(8)
    return rows.agg(F.count_if(F.col("choice") == "B").alias("b"), F.count_if("honest").alias("honest")).select("b", "honest", (F.col("b") < 5).alias("rescope"), (F.col("honest") < 6).alias("revisit"))


def q_stream_dedup(spark, sf):
    """Redelivered messages dropped by a streaming query."""
    return feeds.deduplicated_feed(spark, f"{sf}/events.parquet").select("event_id")


def q_stream_quota(spark, sf):
    """Tokens per day against the daily quota, by a streaming tumbling window."""
    return feeds.daily_quota(spark, f"{sf}/events.parquet", 1_000.0)


def q_stream_sessions(spark, sf):
    """The last three user turns of each conversation, by a stateful stream."""
    return feeds.last_turns(spark, f"{sf}/conversations.parquet")


_RUNS = sql("r", "id, answered, retried, seconds, failures, expected, cited", RUNS).replace("[]", "[]::varchar[]")
_MAN = sql("m", "chapter, first, last, pages, used", MANIFEST)
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"
_COSTS = ", ".join(f"round(parents * 17.2::double * {c!r}::double, 2) as {k}" for k, c in costs().items())

QUERIES = {
    "q_nearest_rank_quantile": (q_nearest_rank_quantile, "with s as (select event_type, list_sort(list(value)) as v from events group by event_type) select event_type, len(v) as n, v[least(floor(0.25 * len(v)), len(v) - 1)::int + 1] as q_25, v[least(floor(0.5 * len(v)), len(v) - 1)::int + 1] as q_50, v[least(floor(0.95 * len(v)), len(v) - 1)::int + 1] as q_95 from s"),
    "q_value_counts": (q_value_counts, "select lang, count(*) as n, sum(length(text))::bigint as chars from documents group by lang"),
    "q_hist_topn": (q_hist_topn, f"with w as (select item_id, unnest({_WORDS.format('text')}) as word, unnest(range(100000)) as spot from benchmark) select word, n from (select word, count(*) as n, min((item_id, spot)) as first from w where word is not null group by word) order by n desc, first limit 14"),
    "q_bag_match": (q_bag_match, f"with a as (select item_id as id, unnest({_WORDS.format('text')}) as word from benchmark), b as (select doc_id as id, unnest({_WORDS.format('text')}) as word from documents), x as (select id, word, count(*) as w from a group by all), y as (select id, word, count(*) as f from b group by all) select id, sum(least(w, coalesce(f, 0)))::bigint as matched, sum(w)::bigint as total from x left join y using (id, word) group by id"),
    "q_cer": (q_cer, "with r as (select item_id % 4 as page, levenshtein(text, regexp_replace(regexp_replace(text, 'th', 'h', 'g'), 'ea', '', 'g')) as d, length(text) as n from benchmark) select page, round(sum(d) / sum(n), 6) as cer, round(avg(d / n), 6) as mean_cer, round(sum(d) / sum(n), 6) as weighted from r group by page"),
    "q_generation_report": (q_generation_report, f"with {_RUNS}, s as (select list_sort(list(seconds) filter (seconds is not null)) as v from r) select count(*) as n, count(*) filter (answered) as ok, count(*) filter (len(list_filter(failures, lambda c: starts_with(c, 'gate:'))) > 0) as gated, count(*) - ok - gated as failed, count(*) filter (retried) as retried, round(count(*) filter (answered and expected = cited) / ok, 6) as precision, any_value(v[least(floor(0.5 * len(v)), len(v) - 1)::int + 1]) as median, any_value(v[least(floor(0.95 * len(v)), len(v) - 1)::int + 1]) as p95 from r, s"),
    "q_failure_codes": (q_failure_codes, f"with {_RUNS} select code, count(*) as n from (select unnest(failures) as code from r) group by code"),
    "q_cost_model": (q_cost_model, f"with {sql('s', 'scale, parents', SCALES)} select scale, {_COSTS}, case when parents * 17.2::double * {costs()['on_demand']!r}::double >= 1e7 then printf('%.2f cr', parents * 17.2::double * {costs()['on_demand']!r}::double / 1e7) when parents * 17.2::double * {costs()['on_demand']!r}::double >= 1e5 then printf('%.2f L', parents * 17.2::double * {costs()['on_demand']!r}::double / 1e5) else printf('%.0f', parents * 17.2::double * {costs()['on_demand']!r}::double) end as shown from s"),
    "q_break_even": (q_break_even, f"with {sql('q', 'quota, parents', QUOTAS)} select quota, floor(parents)::bigint as parents, row_number() over (order by q.parents asc nulls last, quota) as place from q"),
    "q_window_cost": (q_window_cost, f"with c as (select w, avg(length(b.text) + least(length(d.text), w)) as chars from benchmark b join documents d on d.doc_id = b.item_id, (select unnest([900, 1100, 1300, 1550]) as w) group by w), t as (select w, chars, chars / ((select chars from c where w = 900) / {PROMPT}) + {COMPLETION} as total from c) select w, round(chars, 4) as chars, round(total, 4) as tokens, floor(200000 / total)::bigint as answers from t"),
    "q_session_last3": (q_session_last3, "select conv_id, turn, substring(text, 1, 80) as asked from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where role = 'user') where r <= 3"),
    "q_running_feedback": (q_running_feedback, "select event_id, sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as explained from events where event_type in ('click', 'purchase')"),
    "q_dedup_ttl": (q_dedup_ttl, "with recursive e as (select user_id, epoch_us(ts) as us from events), r as (select user_id, min(us) as us from e group by user_id union all select * from (select e.user_id, min(e.us) as us from r join e on e.user_id = r.user_id and e.us - r.us >= 21600000000 group by e.user_id)) select user_id, us from r"),
    "q_manifest_gaps": (q_manifest_gaps, f"with {_MAN} select * from (select chapter, first, pages, coalesce(lead(first) over (order by first), 191) - first as expected from m) where pages <> expected"),
    "q_range_join": (q_range_join, f"with {_MAN} select item_id, chapter, item_id + 1 - first as at from benchmark join m on item_id + 1 between first and last where used"),
    "q_stratified_sample": (q_stratified_sample, "select doc_id, source, turn from (select *, row_number() over (partition by source order by doc_id) as turn from documents) order by turn, source limit 50"),
    "q_preflight_counts": (q_preflight_counts, f"with {sql('c', 'name, state', CHECKS)} select state, count(*) as n from c group by state"),
    "q_interview_rule": (q_interview_rule, f"with {sql('i', 'id, screen, choice, honest', SCREENS)}, k as (select * from i where list_bool_and(screen) order by id limit 8), s as (select count(*) filter (choice = 'B') as b, count(*) filter (honest) as honest from k) select *, b < 5 as rescope, honest < 6 as revisit from s"),
    "q_stream_dedup": (q_stream_dedup, "select event_id from events"),
    "q_stream_sessions": (q_stream_sessions, "select conv_id, string_agg(turn::varchar, ',' order by turn) as turns from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where role = 'user') where r <= 3 group by conv_id"),
    "q_stream_quota": (q_stream_quota, "with d as (select date_trunc('day', ts)::date as day, sum(value) as used from events group by 1) select cast(day as varchar) as day, round(used, 2) as used, used > 1000 as over from d"),
}
