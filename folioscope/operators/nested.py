"""Deeply nested records as flat tables that name their parent, by shared inlining.

The schema is walked as a graph. A struct met once below its parent is inlined into the parent's
table as prefixed columns; an array of structs becomes a table of its own, and one that is met on
several ways (shared) or inside itself (recursive) still becomes a single table. Every row carries
the record's key, its own path and its parent's path, which are the foreign keys. All of it is built
as column expressions over the record, so one scan and one explode give any table without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Element:
    """One table of the mapping: an array's element type."""

    code: str
    fields: dict[str, T.DataType] = field(default_factory=dict)
    parents: set[str] = field(default_factory=set)
    depth: int = 0


def _inlined(struct: T.StructType, prefix: str = "") -> dict[str, T.DataType]:
    """Scalar fields of ``struct`` and of the structs below it that occur once."""
    out: dict[str, T.DataType] = {}
    for f in struct.fields:
        if isinstance(f.dataType, T.StructType):
            out |= _inlined(f.dataType, f"{prefix}{f.name}_")
        elif not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)):
            out[f"{prefix}{f.name}"] = f.dataType
    return out


def _arrays(struct: T.StructType, way: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.StructType]]:
    """Arrays of structs below ``struct``, through structs that occur once."""
    out = []
    for f in struct.fields:
        if isinstance(f.dataType, T.StructType):
            out += _arrays(f.dataType, (*way, f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(((*way, f.name), f.dataType.elementType))
    return out


def schema_graph(root: T.StructType, codes: Mapping[str, str]) -> dict[str, Element]:
    """Tables by code: arrays with the same name or code share a table, however they are reached."""
    tables: dict[str, Element] = {}

    def walk(struct: T.StructType, parent: str, depth: int) -> None:
        for way, element in _arrays(struct):
            code = codes.get(way[-1], way[-1])
            t = tables.setdefault(code, Element(code))
            t.fields |= _inlined(element)
            t.parents.add(parent)
            t.depth = max(t.depth, depth)
            walk(element, code, depth + 1)

    walk(root, "", 1)
    return tables


def _get(x: Column, way: tuple[str, ...]) -> Column:
    for name in way:
        x = x.getField(name)
    return x


def _values(x: Column, struct: T.StructType, fields: Mapping[str, T.DataType]) -> list[Column]:
    """The inlined columns of one element; those its type lacks are null."""
    have = {}

    def walk(v: Column, s: T.StructType, prefix: str) -> None:
        for f in s.fields:
            if isinstance(f.dataType, T.StructType):
                walk(v.getField(f.name), f.dataType, f"{prefix}{f.name}_")
            else:
                have[f"{prefix}{f.name}"] = v.getField(f.name)

    walk(x, struct, "")
    return [(have.get(n, F.lit(None)).cast(t)).alias(n) for n, t in fields.items()]


def _elements(x: Column, struct: T.StructType, parent: Column, prefix: Column, codes: Mapping[str, str], want: str,
              fields: Mapping[str, T.DataType], parts: Mapping[str, tuple[str, str]],
              where: Mapping[str, tuple[str, object]]) -> list[Column]:
    """Arrays of (parent_path, path, kind, inlined columns) of the wanted table below ``x``; ``*`` wants all."""
    out = []

    def row(p: Column, path: Column, kind: str, values: list[Column]) -> Column:
        return F.struct(p.alias("parent_path"), path.alias("path"), F.lit(kind).alias("kind"), *values)

    def pieces(text: Column, pattern: str, path: Column, below: Column, code: str) -> Column:
        parted = F.filter(F.split(F.coalesce(F.trim(text), F.lit("")), pattern), lambda t: t != "")
        return F.transform(parted, lambda t, j: row(path, F.concat(below, F.lit(f"{code}:"), j.cast("string")), code, [t.alias("value")] if want != "*" else []))

    for way, element in _arrays(struct):
        code = codes.get(way[-1], way[-1])
        if want not in ("*", code) and want not in _reach(element, codes, parts):
            continue

        def at(element: T.StructType, code: str, test: tuple[str, object] | None):
            def of(e: Column, i: Column) -> Column:
                path = F.concat(prefix, F.lit(f"{code}:"), i.cast("string"))
                below = F.concat(path, F.lit("/"))
                got = [F.array(row(parent, path, code, _values(e, element, fields) if want != "*" else []))] if want in ("*", code) else []
                got += _elements(e, element, path, below, codes, want, fields, parts, where)
                for name, (pcode, pattern) in parts.items():
                    if name in element.fieldNames() and want in ("*", pcode):
                        got.append(pieces(e.getField(name), pattern, path, below, pcode))
                keep = e.isNotNull()
                if test:
                    keep = keep & (e.getField(test[0]) == test[1])
                return F.when(keep, F.concat(*got) if len(got) > 1 else got[0])

            return of

        lists = F.filter(F.transform(_get(x, way), at(element, code, where.get(code))), lambda a: a.isNotNull())
        out.append(F.flatten(lists))
    return [F.filter(F.coalesce(c, F.array()), lambda r: r.isNotNull()) for c in out]


def _reach(struct: T.StructType, codes: Mapping[str, str], parts: Mapping[str, tuple[str, str]]) -> set[str]:
    out = {parts[n][0] for n in struct.fieldNames() if n in parts}
    for way, element in _arrays(struct):
        out |= {codes.get(way[-1], way[-1])} | _reach(element, codes, parts)
    return out


def flat_table(
    df: DataFrame, key: str, column: str, codes: Mapping[str, str], want: str = "*", root: str = "root",
    parts: Mapping[str, tuple[str, str]] | None = None, where: Mapping[str, tuple[str, object]] | None = None,
) -> DataFrame:
    """One flat table (``want`` = a code) or the parent-child links of all tables (``*``).

    ``codes`` maps an array's field name to its table's code; ``parts`` maps a string field to the
    (code, splitting pattern) of the pieces it holds; ``where`` keeps, per code, the elements whose
    field has a value (places still count all elements). Null arrays and null elements give no
    rows, places stay those of the array. Identical records count once; they meet by a hash of key
    and record, so one that a third of all rows repeat collapses before the shuffle.
    """
    struct = df.schema[column].dataType
    parts, where = parts or {}, where or {}
    graph = schema_graph(struct, codes)
    fields = graph[want].fields if want in graph else {}
    records = df.select(key, column).distinct()
    taken, named = {key.lower(), "parent_path", "path", "kind"}, {}
    for name in fields:  # an element's field never hides a key
        new = name
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        named[name] = new
    lists = _elements(F.col(column), struct, F.lit(root), F.lit(""), codes, want, fields, parts, where)
    if not lists:
        raise ValueError(f"no way leads to {want!r}")
    rows = F.concat(*lists) if len(lists) > 1 else lists[0]
    out = records.select(F.col(key).alias("_0"), F.inline(rows))
    return out.toDF(key, "parent_path", "path", "kind", *(named.values() if want != "*" and want in graph else out.columns[4:]))


def inlined_root(df: DataFrame, key: str, column: str) -> DataFrame:
    """The records themselves with what was inlined into them."""
    struct = df.schema[column].dataType
    return df.select(key, column).distinct().select(key, *_values(F.col(column), struct, _inlined(struct)))


#: Codes of the elements of a whole ALTO page.
ALTO_CODES = {"composed_blocks": "cb", "text_blocks": "tb", "text_lines": "tl", "elems": "st"}
ALTO_PARTS = {"points": ("pt", r"\s+")}
ALTO_WHERE = {"st": ("tag", "String")}


def alto_table(pages: DataFrame, want: str = "*") -> DataFrame:
    """One of the tables ``cb``, ``tb``, ``tl``, ``st``, ``pt`` of nested ALTO pages, or all links."""
    return flat_table(pages, "page_id", "print_space", ALTO_CODES, want, "page", ALTO_PARTS, ALTO_WHERE)
