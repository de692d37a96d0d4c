"""Column builders for text: tokens, numbers, scripts, whitespace. Each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term: a run of Devanagari with its vowel signs, letters with their marks, a fraction, or a number.
TERM = "[\u0900-\u097f]+|[\\p{L}\\p{M}]+|\\d+/\\d+|\\d+"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def tokens(text: Column) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(text, BLANKS), lambda x: x != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty pieces between danda, ?, ! and line breaks; a full stop does not end one."""
    return F.filter(F.transform(F.split(text, "[।?!\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def share(part: Column, rest: Column) -> Column:
    """part / (part + rest), 0 where both are 0."""
    return F.when(part + rest > 0, part / (part + rest)).otherwise(F.lit(0.0))


def devanagari(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[ऀ-ॿ]"))


def latin(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def digit_numbers(text: Column) -> Column:
    """Numbers in digits, blanks and thousands commas dropped: 1,000 and 1000 are one number, 1/2 is one."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+\s*/\s*\d+|\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[\s,]", ""))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm in a fold, enough rounds for any pair of longs."""
    state = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y")), lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0))).alias("y"))))
    return F.abs(state["x"])


def reduced(number: Column) -> Column:
    """A fraction in lowest terms (4/2 is 2/1), anything else as it is."""
    top, under = F.split_part(number, F.lit("/"), F.lit(1)).try_cast("bigint"), F.split_part(number, F.lit("/"), F.lit(2)).try_cast("bigint")
    by = F.greatest(gcd(top, under), F.lit(1))
    lowest = F.concat_ws("/", F.floor(top / by).cast("bigint").cast("string"), F.floor(under / by).cast("bigint").cast("string"))
    return F.when(number.contains("/") & top.isNotNull() & under.isNotNull(), lowest).otherwise(number)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
