"""Text preparation as column expressions: normal forms, character classes, tokens, dictionary text."""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The character classes of the reference measures.
WHITESPACE = " \t\n\r\x0b\x0c"
DASHES_AND_QUOTES = "".join(map(chr, range(0x2012, 0x2020)))
SPACES = " \xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
PUNCTUATION = string.punctuation + DASHES_AND_QUOTES + "⸗" + SPACES
DIGITS = string.digits + "".join(map(chr, range(0x660, 0x66A))) + "".join(map(chr, range(0x6F0, 0x6FA)))
#: White space between tokens, as Unicode defines it.
TOKEN_BREAK = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Characters that a dictionary's words lack.
NOT_IN_WORDS = "0123456789“„\"'?!*.;:-=[]()|"
#: Hyphens at which a line goes on in the next one.
WRAP_HYPHENS = "⸗—-"
#: Marks of direction and joining that training texts do without.
DIRECTION_MARKS = "‏‎﻿‌‬"
SMALL_E = "ͤ"

UNITS = ("characters", "tokens", "unique tokens")


def normalized_whitespace(x: Column) -> Column:
    """Each line break and vertical tab as one blank; tabs and runs of blanks stay."""
    return F.regexp_replace(x, "\r\n|[\r\n\x0b\x0c]", " ")


def normalized_encoding(x: Column, form: str = "NFC") -> Column:
    """The Unicode normal form ``form`` (NFC, NFD, NFKC, NFKD); Spark has no built-in for it."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normal form {form!r}")

    def normal(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts])

    return F.pandas_udf(normal, T.StringType())(x)


def prepared(x: Column, form: str = "NFC") -> Column:
    """Text as the character measures compare it."""
    return normalized_encoding(normalized_whitespace(x), form)


def letters(x: Column) -> Column:
    """Text without white space, punctuation and digits; other signs stay."""
    return F.translate(x, WHITESPACE + PUNCTUATION + DIGITS, "")


def class_removals(x: Column) -> Column:
    """Struct (whitespace, punctuation, digits): characters of each class, each counted once."""
    count = lambda chars: F.length(x) - F.length(F.translate(x, chars, ""))
    only = "".join(c for c in PUNCTUATION if c not in WHITESPACE)
    return F.struct(count(WHITESPACE).alias("whitespace"), count(only).alias("punctuation"), count(DIGITS).alias("digits"))


def tokens(x: Column) -> Column:
    """Tokens between Unicode white space."""
    return F.filter(F.split(x, TOKEN_BREAK), lambda t: t != "")


def token_set(x: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(tokens(x))


def without(words: Column, stop: list[str]) -> Column:
    """Distinct words that are no stop words; case counts."""
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]).cast("array<string>"))


def default_stop_words(spark, languages: tuple[str, ...] = ("german", "english", "russian")) -> list[str]:
    """Stop words that Spark brings for the languages; others are given by the caller."""
    loader = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover
    return sorted({w for lang in languages for w in loader.loadDefaultStopWords(lang)})


def vowels_checked(x: Column) -> Column:
    """Struct (text, misplaced): a, o, u with a small e above as ä, ö, ü; no text where the sign follows another letter."""
    y = x
    for vowels, umlaut in (("aA", "ä"), ("oO", "ö"), ("uU", "ü")):
        accented = {"a": "àáâãäåÀÁÂÃÄÅ", "o": "òóôõöÒÓÔÕÖ", "u": "ùúûüÙÚÛÜ"}[vowels[0]]
        y = F.regexp_replace(y, f"[{vowels}{accented}]{SMALL_E}", umlaut)
    return F.struct(F.when(~y.contains(SMALL_E), y).alias("text"), y.contains(SMALL_E).alias("misplaced"))


def vowels_composed(x: Column) -> Column:
    """``vowels_checked`` that takes the sign after another letter for an error."""
    y = vowels_checked(x)
    return F.when(y["misplaced"], F.raise_error(F.concat(F.lit("no vowel before the small e: "), x)).cast("string")).otherwise(y["text"])


def line_texts(x: Column) -> Column:
    """Stripped lines of a plain text."""
    strip = r"\A[\s\x{1C}-\x{1F}\x{85}\x{A0}]+|[\s\x{1C}-\x{1F}\x{85}\x{A0}]+\z"
    return F.transform(F.split(F.regexp_replace(x, "\n\\z", ""), "\n"), lambda s: F.regexp_replace(s, strip, ""))


def one_line(x: Column) -> Column:
    """A plain text's stripped lines joined by blanks."""
    return F.array_join(line_texts(x), " ")


def unwrapped(lines: Column) -> Column:
    """Lines with the first token of the next one put behind a hyphen at the end, which goes.

    Goes through the lines in order, since a line that lost its first token may itself end in a
    hyphen. Nothing is joined to a line without tokens.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))
    rest = lambda s: F.array_join(F.slice(tokens(s), 2, F.greatest(F.size(tokens(s)) - 1, F.lit(0))), " ")

    def step(acc: Column, line: Column) -> Column:
        last = acc["last"]
        wraps = last.isNotNull() & last.rlike(f"[{WRAP_HYPHENS}]\\z") & (F.size(tokens(line)) > 0)
        joined = F.when(wraps, F.concat(F.substring(last, F.lit(1), F.length(last) - 1), F.get(tokens(line), F.lit(0)))).otherwise(last)
        done = F.when(last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(joined)))
        return F.struct(done.alias("done"), F.when(wraps, rest(line)).otherwise(line).alias("last"))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))


def dictionary_line(x: Column) -> Column:
    """A line's words of two letters or more without digits and signs."""
    return F.array_join(F.filter(tokens(F.translate(x, NOT_IN_WORDS, "")), lambda t: F.length(t) > 1), " ")


def dictionary_text(lines: Column, form: str = "NFKD") -> Column:
    """Lines as one text for dictionaries: broken words whole, signs away, umlauts for a small e above."""
    whole = F.transform(unwrapped(F.filter(lines, lambda s: s != "")), dictionary_line)
    return vowels_composed(normalized_encoding(F.array_join(whole, " "), form))


def reordered(x: Column) -> Column:
    """Tokens in reverse order, for lines kept from right to left."""
    return F.array_join(F.reverse(tokens(x)), " ")


def without_marks(x: Column) -> Column:
    """Text without marks of direction and joining."""
    return F.translate(x, DIRECTION_MARKS, "")


def pair_prefix(stem: Column, prefix: str = "page") -> Column:
    """Numeric file stems as ``page12``, others as they are."""
    return F.when(stem.rlike(r"\A[0-9]+\z"), F.concat(F.lit(prefix), stem.cast("decimal(38,0)").cast("string"))).otherwise(stem)


def step_report(name: str, before: Column, after: Column, unit: str = "characters", details: Column | None = None) -> Column:
    """One step of a preparation: what it found and left, in ``unit``."""
    size = F.length if unit == "characters" else F.size
    return F.struct(
        F.lit(name).alias("name"), size(before).alias("before_count"), F.lit(unit).alias("before_unit"), size(after).alias("after_count"),
        F.lit(unit).alias("after_unit"), (details if details is not None else F.create_map().cast("map<string,int>")).alias("details"),
    )


def step_line(step: Column) -> Column:
    """A step as ``name: before unit -> after unit``."""
    return F.concat(step["name"], F.lit(": "), step["before_count"], F.lit(" "), step["before_unit"], F.lit(" -> "), step["after_count"], F.lit(" "), step["after_unit"])
