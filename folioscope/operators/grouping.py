"""Group keys of evaluation entries: directories, type, file-name patterns and metadata.

An entry is a row with ``path_candidate``, ``root`` (name of the candidates' root directory),
``path_groundtruth``, ``gt_type``, ``tags`` (map) and, for METS and MODS keys, columns named
``mods_<dimension>`` and ``mets_div_<attribute>`` that ``sources.mets`` joins on.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import TRANSFORMS

NOT_AVAILABLE = "n.a."
IGNORED_DIRECTORY = "GT-PAGE"


def directories(path: Column, root: Column) -> Column:
    """Names of the directories from the file's own one up to the one named ``root`` (all, if there is none)."""
    up = F.reverse(F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda d: d != ""))
    at = F.array_position(up, root)
    return F.array_remove(F.when(at > 0, F.slice(up, F.lit(1), at.cast("int"))).otherwise(up), IGNORED_DIRECTORY)


def type_of_name(name: Column) -> Column:
    """``article`` or ``announcement`` by the tag in ``….art.gt.xml`` or ``….gt.art.xml``, else ``n.a.``."""
    tag = F.coalesce(
        F.nullif(F.regexp_extract(name, r"gt.(\w{3,}).xml\z", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"\.(\w{3,})\.gt\.xml\z", 1), F.lit(""))
    )
    return F.when(tag.startswith("art"), "article").when(tag.startswith("ann"), "announcement").otherwise(NOT_AVAILABLE)


@dataclass(frozen=True)
class Dimension:
    """A named group key: an expression that is a string or an array of strings; null = no value."""

    name: str
    column: Column
    many: bool = False

    def values(self) -> Column:
        """The values as an array without nulls."""
        return F.array_compact(self.column if self.many else F.array(self.column))

    def first(self) -> Column:
        """The only or the first value."""
        return F.get(self.column, F.lit(0)) if self.many else self.column


def directory_dimension(level: int | None = None) -> Dimension:
    """All directories, or one: -1 the file's own, 0 the topmost, 1 the one below it."""
    dirs = F.col("directories")
    if level is None:
        return Dimension("directory", F.when(F.size(dirs) > 0, dirs), many=True)
    at = F.lit(0) if level == -1 else F.size(dirs) - 1 - level
    ok = F.size(dirs) > 0 if level == -1 else (F.size(dirs) > level) & F.lit(level >= 0)
    return Dimension(f"directory_{level}", F.when(ok, F.get(dirs, at)))


def pattern_dimension(pattern: str, group: int = 0) -> Dimension:
    """A group of a regular expression sought in the candidate's file name; null without a match."""
    name = F.element_at(F.split("path_candidate", "/"), -1)
    return Dimension(f"pattern_{pattern}", F.when(name.rlike(pattern), F.regexp_extract(name, pattern, group)))


#: MODS dimensions known by name; a path (``.//…``) is possible as well.
MODS_DIMENSIONS = (
    "language", "languageTerm", "genre", "dateIssued", "dateCreated", "publisher", "place", "title", "author", "subject", "classification", "accessCondition",
)


def parse_dimension(spec: str) -> Dimension:
    """The group key that ``spec`` describes, or a ValueError.

    ``directory[:all|:N]``, ``type``, ``metadata:KEY``, ``pattern:REGEX[:GROUP]``,
    ``mods:DIMENSION[:decade|:century]``, ``mets:ATTRIBUTE``.
    """
    kind, _, rest = spec.strip().partition(":")
    if kind == "directory":
        if rest in ("", "all"):
            return directory_dimension()
        if re.fullmatch(r"-?\d+", rest):
            return directory_dimension(int(rest))
    elif kind == "type" and not rest:
        return Dimension("type", F.when(F.col("gt_type") != NOT_AVAILABLE, F.col("gt_type")))
    elif kind == "metadata" and rest:
        return Dimension(f"metadata_{rest}", F.col("tags")[rest])
    elif kind == "pattern" and rest:
        head, _, tail = rest.rpartition(":")
        pattern, group = (head, int(tail)) if head and tail.isdigit() else (rest, 0)
        re.compile(pattern)
        return pattern_dimension(pattern, group)
    elif kind == "mods" and rest:
        name, _, transform = rest.partition(":") if not rest.startswith(".//") else (rest, "", "")
        if name in MODS_DIMENSIONS or name.startswith(".//"):
            column = F.col(f"`mods_{name}`")
            if not transform:
                return Dimension(f"mods_{name}", column)
            if transform in TRANSFORMS:
                return Dimension(f"mods_{name}_{transform}", TRANSFORMS[transform](column))
    elif kind == "mets" and rest:
        return Dimension(f"mets_div_{rest.lower()}", F.col(f"`mets_div_{rest.lower()}`"))
    raise ValueError(f"no group key: {spec!r}")


@dataclass(frozen=True)
class Grouping:
    """Dimensions with or without the composite key of all of them."""

    dimensions: tuple[Dimension, ...]
    hierarchical: bool = False

    @classmethod
    def parse(cls, spec: str) -> Grouping:
        """``a,b`` gives one key per dimension, ``a+b`` the composite key as well."""
        nested = "+" in spec
        parts = [p for p in (x.strip() for x in spec.split("+" if nested else ",")) if p]
        if not parts:
            raise ValueError("no group key given")
        bad, dims = [], []
        for p in parts:
            try:
                dims.append(parse_dimension(p))
            except (ValueError, re.error):
                bad.append(p)
        if bad:
            raise ValueError(f"no group keys: {', '.join(bad)}")
        return cls(tuple(dims), nested)

    def keys(self, metric: Column) -> Column:
        """All keys of a row, as an array: ``metric@name:value`` and the composite ``metric@a:x/b:y``."""
        named = lambda d: (lambda v: F.concat(metric, F.lit(f"@{d.name}:"), v))
        arrays = [F.transform(d.values(), named(d)) for d in self.dimensions]
        if self.hierarchical:
            parts = [F.concat(F.lit(f"{d.name}:"), d.first()) for d in self.dimensions]
            whole = F.concat(metric, F.lit("@"), *[x for i, p in enumerate(parts) for x in ([F.lit("/")] if i else []) + [p]])
            arrays.append(F.array_compact(F.array(whole)))
        return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def explode_keys(scores: DataFrame, grouping: Grouping) -> DataFrame:
    """One row per score and key, in column ``eval_key``; a row without values has no keys."""
    return scores.withColumn("eval_key", F.explode(grouping.keys(F.col("metric"))))


def explode_directories(scores: DataFrame, by_type: bool = False) -> DataFrame:
    """One row per score and directory of its chain (key ``metric@directory``); with ``by_type`` also
    ``metric@root@type`` where the type is known."""
    own = F.transform("directories", lambda d: F.concat("metric", F.lit("@"), d))
    if by_type:
        top = F.element_at("directories", -1)
        typed = F.when((F.col("gt_type") != NOT_AVAILABLE) & (F.size("directories") > 0), F.concat("metric", F.lit("@"), top, F.lit("@"), F.col("gt_type")))
        own = F.concat(own, F.array_compact(F.array(typed)))
    return scores.withColumn("eval_key", F.explode(own))


def coverage(entries: DataFrame, grouping: Grouping) -> DataFrame:
    """Per dimension the entries with a value and those without."""
    has = [F.sum(F.when(F.size(d.values()) > 0, 1).otherwise(0)).alias(f"n{i}") for i, d in enumerate(grouping.dimensions)]
    row = entries.agg(F.count("*").alias("n"), *has)
    listed = [
        F.struct(F.lit(d.name).alias("dimension"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("with_value"), (F.col("n") - F.coalesce(F.col(f"n{i}"), F.lit(0))).alias("omitted"))
        for i, d in enumerate(grouping.dimensions)
    ]
    return row.select(F.inline(F.array(*listed)))


Extractor = Callable[[], Column]


def with_entry_columns(entries: DataFrame) -> DataFrame:
    """Adds ``directories`` and, where missing, ``gt_type`` and ``tags``."""
    out = entries.withColumn("directories", directories(F.col("path_candidate"), F.col("root")))
    if "gt_type" not in out.columns:
        out = out.withColumn("gt_type", type_of_name(F.element_at(F.split("path_groundtruth", "/"), -1)))
    if "tags" not in out.columns:
        out = out.withColumn("tags", F.create_map().cast("map<string,string>"))
    return out
