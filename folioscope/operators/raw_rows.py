"""Typed rows out of delivered text lines; lines that break their feed's format come out apart.

One anchored regular expression is generated per feed for the whole line, so a valid line costs
one match. Only lines that fail it pass through the feed's incremental field-prefix patterns
(prefix *k* = the first *k* fields followed by a separator or the end), of which the first that
fails names the first broken field. Everything is one map over the lines: no shuffle, no Python.

Stack safety: an enclosed text uses possessive groups, which Java matches in a loop and not by
recursion, so a field of megabytes does not overflow the stack.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_collect, fresh_name

#: Feeds that may be described at most: their patterns are literals of the plan.
MAX_FEEDS = 2000

#: Characters no text field may hold: U+FFFD and controls other than tab and line feed.
_BAD = r"\x00-\x08\x0B-\x1F\x7F-\x9F�"

#: Joins the captured fields of a valid line; it is a control character, so no valid field has it.
_GLUE = "\u0001"


@dataclass(frozen=True)
class Feed:
    """Layout of one feed's lines."""

    feed_id: int
    sep: str
    quote: str
    fields: tuple[str, ...]


def field_kind(name: str) -> str:
    """The kind of value a field holds, by its name."""
    if name.endswith("_id"):
        return "id"
    return {
        "hpos": "digits", "vpos": "digits", "width": "size", "height": "size", "points": "points",
        "wc": "ratio", "conf": "ratio", "region_type": "region_type",
    }.get(name, "text")


#: Value pattern of each kind that holds neither quotes nor line feeds, and the characters it may use.
_VALUES = {
    "id": (r"[A-Za-z_][A-Za-z0-9_.\-]*+", r"[A-Za-z0-9_.\-]"),
    "digits": (r"[0-9]++", r"[0-9]"),
    "size": (r"0*+[1-9][0-9]*+", r"[0-9]"),
    "points": (r" *+[0-9]++,[0-9]++(?: ++[0-9]++,[0-9]++){2,}+ *+", r"[0-9, ]"),
    "ratio": (r"(?:0(?:\.[0-9]++)?|1(?:\.0++)?)?", r"[01.]"),
    "region_type": (r"(?:TextRegion|TableCell)", r"[A-Za-z]"),
}


def _lit(s: str) -> str:
    """``s`` inside a Java pattern, in or out of a character class."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in s)


def field_pattern(kind: str, sep: str, quote: str) -> str:
    """Pattern of one field: bare, or enclosed with inner quote characters doubled."""
    s, q = _lit(sep), _lit(quote)
    if kind == "text":
        return f"(?:{q}(?:[^{q}{_BAD}]++|{q}{q})*+{q}|[^{s}{q}\\n{_BAD}]*+)"
    value, alphabet = _VALUES[kind]
    if re.fullmatch(alphabet, quote):
        raise ValueError(f"the quote character {quote!r} is part of {kind} values")
    enclosed = f"{q}{value}{q}"
    if not re.fullmatch(alphabet, sep):
        return f"(?:{enclosed}|{value})"
    if kind == "points" and sep in " ,":  # every value holds the separator
        return enclosed
    bare = f"(?=[^{s}{q}\\n]*+(?:{s}|\\z))(?:{value})(?={s}|\\z)".replace("*+", "*").replace("++", "+")
    return f"(?:{enclosed}|{bare})"


def row_pattern(feed: Feed) -> str:
    """Anchored pattern of a whole line with one group per field."""
    parts = [f"({field_pattern(field_kind(f), feed.sep, feed.quote)})" for f in feed.fields]
    return r"\A" + _lit(feed.sep).join(parts) + r"\z"


def prefix_patterns(feed: Feed) -> list[str]:
    """For each k the pattern of the first k fields, followed by a separator or the end."""
    s = _lit(feed.sep)
    parts = [field_pattern(field_kind(f), feed.sep, feed.quote) for f in feed.fields]
    return [rf"\A{s.join(parts[:k])}(?={s}|\z)" for k in range(1, len(parts) + 1)]


def shape_pattern(feed: Feed, k: int) -> str:
    """The first k fields by their outer form only: any bare or enclosed text."""
    s, q = _lit(feed.sep), _lit(feed.quote)
    any_field = f"(?:{q}(?:[^{q}]++|{q}{q})*+{q}|[^{s}{q}\\n]*+)"
    return rf"\A{s.join([any_field] * k)}(?={s}|\z)"


def _reason(line: Column, feed: Feed) -> Column:
    """Struct (reason, field) for a line that does not match the feed's row pattern."""
    n = len(feed.fields)
    prefixes = prefix_patterns(feed)
    out = None
    said = lambda why, field: F.struct(F.lit(why).alias("reason"), F.lit(field).alias("field"))
    # Built from the last field backwards: the first failing prefix decides.
    out = said("extra_fields", None)
    for k in range(n, 0, -1):
        name, kind = feed.fields[k - 1], field_kind(feed.fields[k - 1])
        broken = F.when(~line.rlike(shape_pattern(feed, k)), said("broken_quoting", name)).otherwise(
            said("bad_text" if kind == "text" else f"bad_{kind}", name)
        )
        if k > 1:
            ends = shape_pattern(feed, k - 1).removesuffix(rf"(?={_lit(feed.sep)}|\z)") + r"\z"
            broken = F.when(line.rlike(ends), said("missing_fields", name)).otherwise(broken)
        out = F.when(~line.rlike(prefixes[k - 1]), broken).otherwise(out)
    return out


def read_feeds(raw_feed: DataFrame) -> list[Feed]:
    """The feeds' layouts, read once on the driver; at most ``MAX_FEEDS``."""
    rows = bounded_collect(raw_feed.select("feed_id", "sep_char", "quote_char", "field_names").distinct(), MAX_FEEDS, "raw_feed")
    return [
        Feed(r.feed_id, r.sep_char, r.quote_char, tuple(x.strip() for x in r.field_names.split(",")))
        for r in sorted(rows, key=lambda r: r.feed_id)
    ]


def check_rows(raw: DataFrame, feeds: Sequence[Feed], line: str = "raw_line", feed_id: str = "feed_id") -> DataFrame:
    """``raw`` with the columns ``reject_reason`` and ``reject_field`` (null on a valid line) and
    ``row_text`` (the line without one closing carriage return).

    Reasons: ``null_line``, ``unknown_feed`` (no such feed, or null), ``missing_fields``,
    ``extra_fields``, ``broken_quoting``, ``bad_text`` and ``bad_<kind>``; the field is the first
    broken one. An empty line is a line with one empty field. Rows that stand again keep their
    number; an empty table gives an empty table. Columns of ``raw`` that carry one of the three
    names get an underscore appended to the new name instead.
    """
    text_col = fresh_name(raw, "row_text")
    out = raw.withColumn(text_col, F.regexp_replace(F.col(line), r"\r\z", ""))
    text, verdict = F.col(text_col), None
    nothing = F.lit(None).cast("struct<reason:string,field:string>")
    verdict = F.struct(F.lit("unknown_feed").alias("reason"), F.lit(None).cast("string").alias("field"))
    for feed in feeds:
        one = F.when(text.rlike(row_pattern(feed)), nothing).otherwise(_reason(text, feed))
        verdict = F.when(F.col(feed_id) == feed.feed_id, one).otherwise(verdict)
    verdict = F.when(text.isNull(), F.struct(F.lit("null_line").alias("reason"), F.lit(None).cast("string").alias("field"))).otherwise(verdict)
    tmp = fresh_name(out, "reject")
    out = out.withColumn(tmp, verdict)
    return out.withColumns({
        fresh_name(raw, "reject_reason"): F.col(tmp)["reason"],
        fresh_name(raw, "reject_field"): F.col(tmp)["field"],
    }).drop(tmp)


def broken_rows(raw: DataFrame, feeds: Sequence[Feed], line: str = "raw_line", feed_id: str = "feed_id") -> DataFrame:
    """The rejected lines of ``raw`` with reason and first broken field; see ``check_rows``."""
    return check_rows(raw, feeds, line, feed_id).filter(F.col(fresh_name(raw, "reject_reason")).isNotNull())


def _typed(v: Column, name: str, quote: str) -> Column:
    """A field's text as a value of its kind, with the quotes undone."""
    v = F.when(v.startswith(quote), F.replace(F.substring(v, 2, F.length(v) - 2), F.lit(quote + quote), F.lit(quote))).otherwise(v)
    kind = field_kind(name)
    if kind in ("digits", "size"):
        return v.try_cast("bigint")
    if kind == "ratio":
        return v.try_cast("double")
    if kind == "points":
        number = lambda p, i: F.split_part(p, F.lit(","), F.lit(i)).try_cast("bigint")
        return F.transform(F.split(F.trim(v), " +"), lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))
    return v


def loaded_rows(raw: DataFrame, feeds: Sequence[Feed], line: str = "raw_line", feed_id: str = "feed_id", keep: Sequence[str] = ("raw_id", "feed_id")) -> DataFrame:
    """The valid lines of all feeds in one pass, as typed columns after the columns ``keep``.

    There is one column per field name of any feed; a feed without that field has null there. Numbers
    become bigint (null beyond its range), ratios double (null where empty), points an array of (x, y)
    structs, all else string with the quotes undone. A field that shares its name with a kept column
    comes out as ``<name>_``. Each line is matched once: a valid line comes back from its pattern with a
    control character before every field, which no valid line holds; any other comes back as it was.
    """
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    marked = F.lit(None).cast("string")
    for feed in feeds:
        split = F.regexp_replace(text, row_pattern(feed), "".join(f"{_GLUE}${i + 1}" for i in range(len(feed.fields))))
        marked = F.when(F.col(feed_id) == feed.feed_id, split).otherwise(marked)
    rows = raw.filter(F.col(feed_id).isin([f.feed_id for f in feeds])).select("*", text.alias("__text"), marked.alias("__marked")).filter("__marked <> __text")
    rows = rows.withColumn("__fields", F.split("__marked", _GLUE, -1))
    taken, cols = {k.lower() for k in keep}, []
    for name in dict.fromkeys(n for f in feeds for n in f.fields):
        value = None
        for feed in feeds:
            if name in feed.fields:
                one = _typed(F.get("__fields", F.lit(feed.fields.index(name) + 1)), name, feed.quote)
                value = F.when(F.col(feed_id) == feed.feed_id, one) if value is None else value.when(F.col(feed_id) == feed.feed_id, one)
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        cols.append(value.alias(name))
    return rows.select(*keep, *cols)


def typed_rows(raw: DataFrame, feed: Feed, line: str = "raw_line", feed_id: str = "feed_id", keep: Sequence[str] = ("raw_id",)) -> DataFrame:
    """``loaded_rows`` of one feed."""
    return loaded_rows(raw, [feed], line, feed_id, keep)
