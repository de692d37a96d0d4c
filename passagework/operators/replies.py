"""Around a generated reply: errors, limits, declines, retries, rescues, refusals, signatures, alignment."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import rules
from passagework.functions import text as T

#: Reasons of a refusal whose page a parent may be shown, and what is said for it.
DEFAULT = "मुझे इसका पक्का जवाब नहीं पता।"
NO_PAGE = ("query_pre_check", "query_vocabulary", "class_metadata")
RESCUABLE = ("figure_value_lookup", "answer_is_in_a_chart")


def error_kind(message: Column) -> Column:
    """exhausted: the day's budget is spent; wait: a limit that passes; other."""
    return F.when(message.contains("tokens per day") | message.contains("TPD"), "exhausted").when(F.lower(message).contains("rate limit"), "wait").otherwise("other")


def limits(headers: Column) -> Column:
    """map of the x-ratelimit headers among lines of `name: value`."""
    lines = F.filter(F.split(headers, "\r?\n"), lambda x: F.lower(x).startswith("x-ratelimit") & x.contains(":"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v"))))


def declined(raw: Column, marker: str) -> Column:
    return F.contains(F.substring(raw, 1, 80), F.lit(marker))


def final(attempts: DataFrame) -> DataFrame:
    """(id, raw, retried): the first attempt of at most two that passed; null if none did."""
    good = F.when(F.col("ok"), F.col("raw"))
    return attempts.where("attempt <= 2").groupBy("id").agg(F.min_by(good, F.when(F.col("ok"), F.col("attempt"))).alias("raw"), (F.max("attempt") > 1).alias("retried"))


def reading(text: Column) -> Column:
    """A figure's reading, null where the reader found nothing there."""
    t = F.trim(text)
    return F.when((t != "") & ~F.upper(F.substring(t, 1, 40)).contains("NONE") & ~F.substring(t, 1, 20).contains("अपर") & (F.length(t) >= 12), t)


def rescued(gates: DataFrame, readings: DataFrame) -> DataFrame:
    """Gate rows whose refusal a figure's reading lifts, for the two reasons that a figure can answer."""
    known = readings.select("id", reading(F.col("text")).alias("reading"))
    lift = F.col("refuse") & F.col("reason").isin(*RESCUABLE) & F.col("reading").isNotNull()
    return gates.join(known, "id", "left").select("id", (F.col("refuse") & ~lift).alias("refuse"), F.when(~lift, F.col("reason")).alias("reason"), F.when(lift, F.col("reading")).alias("reading"))


def refusal(reason: Column, layer: Column, outcome: Column, page: Column, spoken: dict[str, str]) -> Column:
    """struct(spoken, kind, page): what is said, whether it asks back, and the page shown unless the layer rules it out."""
    said = F.create_map(*(F.lit(x) for pair in spoken.items() for x in pair))
    return F.struct(F.coalesce(said[reason], F.lit(DEFAULT)).alias("spoken"), F.when(outcome == "clarify", "clarify").otherwise("refusal").alias("kind"), F.when(~layer.isin(*NO_PAGE), page).alias("page"))


def kept_if_target(rewritten: Column, original: Column) -> Column:
    """The rewrite if under 0.4 of its letters are Latin, else the original."""
    return F.when((F.length(F.trim(F.coalesce(rewritten, F.lit("")))) > 0) & (T.share(T.latin(rewritten), T.devanagari(rewritten)) < 0.4), rewritten).otherwise(original)


def stub(passage: Column, question: Column) -> Column:
    """Two numbers of at most two digits from the passage that the question lacks, else 2 and 4, as an example's line."""
    asked = F.regexp_extract_all(question, F.lit("(\\d+)"), F.lit(1))
    fresh = F.filter(F.regexp_extract_all(passage, F.lit("(\\d+)"), F.lit(1)), lambda n: ~F.array_contains(asked, n) & (F.length(n) <= 2) & (n != "0"))
    two = F.slice(F.concat(fresh, F.array(F.lit("2"), F.lit("4"))), 1, 2)
    return F.format_string("3. जैसे %s और %s", two[0], two[1])


def best_window(wanted: Column, text: Column) -> Column:
    """The part of text, as long as `wanted`, with the least edit distance from it; the first on ties; null if either is."""
    n = F.length(wanted)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
    found = F.array_min(F.transform(at, lambda i: F.struct(F.levenshtein(wanted, F.substring(text, i, n)).alias("d"), i.alias("i"))))
    return F.substring(text, found["i"], n)


def likeness(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def signed(body: Column, signature: Column, secret: str) -> Column:
    """Whether a signature `sha256=<hex>` is the body's under the secret (HMAC); digests are compared, so timing tells nothing."""
    key = secret.encode()
    key = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(k ^ x for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    wanted = F.concat(F.lit("sha256="), F.sha2(F.concat(pad(0x5C), inner), 256))
    return F.coalesce(F.sha2(wanted, 256) == F.sha2(signature, 256), F.lit(False))


def gate(question: Column, lead: Column, review: Column, axis: Column, all_axis: Column, score: Column, margin: float = 0.08, floor: float = 0.30) -> Column:
    """struct(refuse, reason, layer): the question's own check, then other books, review flag, chart axes, similarity."""
    p = rules.pre_check(question)
    say = lambda reason, layer: F.struct(F.lit(True).alias("refuse"), reason.alias("reason"), F.lit(layer).cast("string").alias("layer"))
    return (
        F.when(p["outcome"] != "pass", say(p["reason"], "query_pre_check")).when(lead >= margin, say(F.lit("out_of_syllabus_by_margin"), "class_metadata")).when(review, say(F.lit("chunk_below_extraction_gate"), "chunk_flag"))
        .when(rules.value_seeking(question) & axis & all_axis, say(F.lit("answer_is_in_a_chart"), "chart_axis")).when(score < floor, say(F.lit("below_similarity_floor"), "similarity"))
        .otherwise(F.struct(F.lit(False).alias("refuse"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("layer")))
    )
