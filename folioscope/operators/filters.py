"""Filters of entries by metadata, with a report of what they leave out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import Dimension, parse_dimension

_PARTS = r"[+|,]"


def label_set(x: Column) -> Column:
    """The labels of a value that joins several by ``+``, ``|`` or ``,``."""
    return F.array_distinct(F.filter(F.transform(F.split(x, _PARTS), lambda t: F.trim(t)), lambda t: t != ""))


def value_matches(actual: Column, expected: Column) -> Column:
    """Equality of one expected label; of several, all must be among the actual ones."""
    want = label_set(expected)
    many = (F.size(want) > 0) & (F.size(F.array_except(want, label_set(actual))) == 0)
    return F.when(expected.rlike(_PARTS), many).otherwise(F.trim(actual) == F.trim(expected))


@dataclass(frozen=True)
class Filter:
    """``dimension=value``."""

    dimension: Dimension
    expected: str

    @classmethod
    def parse(cls, spec: str) -> Filter:
        left, eq, right = spec.partition("=")
        if not eq or not left.strip() or not right.strip():
            raise ValueError(f"a filter reads EXTRACTOR=VALUE, not {spec!r}")
        return cls(parse_dimension(left), right.strip())

    def outcome(self) -> Column:
        """``kept``, ``different`` or ``missing`` (null or blank value)."""
        values = F.filter(self.dimension.values(), lambda v: F.trim(v) != "")
        hit = F.exists(values, lambda v: value_matches(v, F.lit(self.expected)))
        return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, "missing").when(hit, "kept").otherwise("different")


def apply_filters(entries: DataFrame, filters: list[Filter]) -> DataFrame:
    """Entries that every filter keeps."""
    for f in filters:
        entries = entries.filter(f.outcome() == "kept")
    return entries


def filter_report(entries: DataFrame, f: Filter) -> DataFrame:
    """One row: entries before, kept, different, missing, and the percentage left out (0 if there are none)."""
    n = F.count("*")
    is_ = lambda what: F.coalesce(F.sum(F.when(F.col("_o") == what, 1).otherwise(0)), F.lit(0))
    return entries.select(f.outcome().alias("_o")).agg(
        n.alias("before"), is_("kept").alias("kept"), is_("different").alias("different"), is_("missing").alias("missing"),
        F.when(n > 0, 100.0 * (n - is_("kept")) / F.nullif(n, F.lit(0).cast("bigint"))).otherwise(0.0).alias("percent_left_out"),
    )


def without_partner(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` that ``right`` has no partner for."""
    return left.join(right, on, "left_anti")


def long_enough(text: Column, least: int) -> Column:
    """Whether a line's text has at least ``least`` characters; an empty one never."""
    return (F.length(F.trim(text)) > 0) & (F.length(text) >= least)
