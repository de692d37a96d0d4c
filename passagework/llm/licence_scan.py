"""Licences by canonical digest.

A text's canonical form is lower-case, without the lines that begin with a copyright mark, with one space
for any run of what is neither letter nor digit, and with one of several equivalent spellings. The digest
of a whole text's form is hash-joined with those of the known licences; in the same way each of its lines
is looked up among known one-line notices. Both known tables are constants, so their size is bounded.
The plan has DataFrame functions only.

A null text, or one without letters and digits, has no licence; null ids are allowed; equal rows get equal
results; if two known texts had one form, the first by name would win; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm import storage
from passagework.llm.licences import EQUIVALENT, NOTICES, TEXTS

COPYRIGHT = "(^|\n)[^a-z0-9\n]*(copyright|[(]c[)]|©)[^\n]*"
OTHER = "[^\\p{L}\\p{N}\n]+"
SPELT = "(" + "|".join(EQUIVALENT) + ")"


def lines(text: Column) -> Column:
    """Canonical form, line by line."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, "$1"), OTHER, " ")
    spelt = plain
    for word, same in EQUIVALENT.items():
        spelt = F.regexp_replace(spelt, f"\\b{word}\\b", same)
    return F.when(plain.rlike(SPELT), spelt).otherwise(plain)


def whole(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(canonical, "[ \n]+", " "))


def known(spark) -> tuple[DataFrame, DataFrame]:
    """(licence, digest) of whole texts and of notices."""
    texts = spark.createDataFrame(sorted(TEXTS.items()), "licence string, text string")
    notices = spark.createDataFrame(sorted((name, line) for name, each in NOTICES.items() for line in each), "licence string, text string")
    return tuple(t.select("licence", F.sha2(whole(lines(F.col("text"))), 256).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence")) for t in (texts, notices))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest (null without letters and digits), licence (of the whole text, or null), notices (sorted array of licences)."""
    rows, _ = storage.keyed(docs, id_col, text_col)
    texts, notices = known(docs.sparkSession)
    form = rows.select("_k", "_id", lines(F.col("_text")).alias("form"))
    form = form.select("_k", "_id", F.sha2(F.nullif(whole(F.col("form")), F.lit("")), 256).alias("digest"), F.split("form", "\n").alias("each"))
    form = form.select("_k", "_id", "digest", F.explode_outer("each").alias("line"))  # the digest is made before, not for each line
    each = form.select("_k", "_id", "digest", F.sha2(F.trim("line"), 256).alias("line"))
    named = each.join(F.broadcast(notices.select(F.col("digest").alias("line"), F.col("licence").alias("notice"))), "line", "left")
    named = named.groupBy("_k", "_id", "digest").agg(F.sort_array(F.collect_set("notice")).alias("notices"))
    return named.join(F.broadcast(texts), "digest", "left").select(F.col("_id").alias(id_col), "digest", "licence", "notices")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same result in SQL; notices joined by commas."""
    def form(column: str) -> str:
        plain = f"regexp_replace(regexp_replace(lower({column}), {_quoted(COPYRIGHT)}, '\\1', 'g'), {_quoted(OTHER)}, ' ', 'g')"
        for word, same in EQUIVALENT.items():
            plain = f"regexp_replace({plain}, {_quoted(chr(92) + 'b' + word + chr(92) + 'b')}, {_quoted(same)}, 'g')"
        return plain

    def one(column: str) -> str:
        return f"trim(regexp_replace({column}, '[ \n]+', ' ', 'g'))"

    texts = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEXTS.items()))
    notices = ", ".join(f"({_quoted(k)}, {_quoted(x)})" for k, v in NOTICES.items() for x in v)
    return f"""
    with known as (select sha256({one(form('t'))}) as digest, min(l) as licence from (values {texts}) as v(l, t) group by 1),
    notices as (select sha256({one(form('t'))}) as digest, min(l) as licence from (values {notices}) as v(l, t) group by 1),
    forms as (select doc_id, {form('text')} as form from documents),
    named as (select doc_id, string_agg(distinct licence, ',' order by licence) as notices
              from (select doc_id, sha256(trim(unnest(string_split(form, chr(10))))) as digest from forms) join notices using (digest) group by doc_id),
    digests as (select doc_id, sha256(nullif({one('form')}, '')) as digest from forms)
    select doc_id, digest, licence, coalesce(n.notices, '') as notices from digests left join known using (digest) left join named n using (doc_id)"""
