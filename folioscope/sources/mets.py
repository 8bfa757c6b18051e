"""METS files with MODS sections as small tables, and metadata of evaluation entries from them.

All tables carry ``mets`` (the file's path), so that any number of METS files is read in one pass; what
one file says is never mixed with another's. ``ord`` is the place in the document: first or last match
is always a matter of it. An entry that several METS files name takes the first of them by path.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

NS = {"mets": "http://www.loc.gov/METS/", "mods": "http://www.loc.gov/mods/v3", "xlink": "http://www.w3.org/1999/xlink"}
_HREF = f"{{{NS['xlink']}}}href"

# Where the known dimensions stand in a MODS section.
DIMENSION_PATHS = {
    "language": ".//mods:language/mods:languageTerm[@type='code']",
    "languageTerm": ".//mods:language/mods:languageTerm",
    "genre": ".//mods:genre",
    "dateIssued": ".//mods:originInfo/mods:dateIssued",
    "dateCreated": ".//mods:originInfo/mods:dateCreated",
    "publisher": ".//mods:originInfo/mods:publisher",
    "place": ".//mods:originInfo/mods:place/mods:placeTerm",
    "title": ".//mods:titleInfo/mods:title",
    "author": ".//mods:name/mods:namePart",
    "subject": ".//mods:subject/mods:topic",
    "classification": ".//mods:classification",
    "accessCondition": ".//mods:accessCondition",
}

_SCHEMA = (
    "mets string, part string, ord int, file_id string, href string, grp_use string, file_dmdid string, grp_dmdid string, kind string, div_id string, "
    "dmdid string, attrs map<string,string>, from_id string, to_id string, dimension string, value string"
)
_COLUMNS = [c.split(" ")[0] for c in _SCHEMA.split(", ")]


@dataclass(frozen=True)
class Mets:
    """The tables of one or many METS files."""

    file: DataFrame
    div: DataFrame
    fptr: DataFrame
    link: DataFrame
    mods: DataFrame


def _rows(path: str, content: bytes, paths: dict[str, str]) -> Iterator[dict]:
    root = ET.fromstring(content)
    n = iter(range(10**9))
    row = lambda part, **v: {c: None for c in _COLUMNS} | {"mets": path, "part": part, "ord": next(n)} | v
    for dmd in root.iter(f"{{{NS['mets']}}}dmdSec"):
        for section in dmd.iter(f"{{{NS['mods']}}}mods"):
            for name, xpath in paths.items():
                for hit in section.findall(xpath, NS):
                    if hit.text:
                        yield row("mods", dmdid=dmd.get("ID"), dimension=name, value=hit.text)
    # Groups before and after their members, so that a file takes the attributes of the group right above it.
    for grp in root.iter(f"{{{NS['mets']}}}fileGrp"):
        for f in grp.findall("mets:file", NS):
            loc = f.find("mets:FLocat", NS)
            if loc is not None and loc.get(_HREF):
                yield row("file", file_id=f.get("ID"), href=loc.get(_HREF), grp_use=grp.get("USE"), file_dmdid=f.get("DMDID"), grp_dmdid=grp.get("DMDID"))
    for m in root.iter(f"{{{NS['mets']}}}structMap"):
        for div in m.iter(f"{{{NS['mets']}}}div"):
            if div.get("ID"):
                yield row("div", kind=m.get("TYPE"), div_id=div.get("ID"), dmdid=div.get("DMDID"), attrs={k: v for k, v in div.attrib.items() if not k.startswith("{")})
                for p in div.findall("mets:fptr", NS):
                    yield row("fptr", div_id=div.get("ID"), file_id=p.get("FILEID"))
    for link in root.iter(f"{{{NS['mets']}}}smLink"):
        yield row("link", from_id=link.get(f"{{{NS['xlink']}}}from"), to_id=link.get(f"{{{NS['xlink']}}}to"))


def read_mets(rows: DataFrame, dimensions: dict[str, str] | None = None) -> Mets:
    """The tables of the METS files in ``rows`` (path, content); ``dimensions`` adds MODS paths by name."""
    paths = DIMENSION_PATHS | (dimensions or {})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(_rows(path, bytes(content), paths)), columns=_COLUMNS)

    all_ = cut(rows.select("path", "content").mapInPandas(parse, _SCHEMA))
    part = lambda name, *cols: all_.filter(F.col("part") == name).select("mets", *cols, "ord")
    return Mets(
        part("file", "file_id", "href", "grp_use", "file_dmdid", "grp_dmdid"), part("div", "kind", "div_id", "dmdid", "attrs"),
        part("fptr", "div_id", "file_id"), part("link", "from_id", "to_id"), part("mods", "dmdid", "dimension", "value"),
    )


def fulltext_refs(files: DataFrame) -> DataFrame:
    """Files of the groups whose use names a full text."""
    return files.filter(F.upper("grp_use").contains("FULLTEXT"))


def _linked(m: Mets, logical: DataFrame) -> DataFrame:
    """Files with the logical divs that structural links lead to: (mets, href, link_ord, … of ``logical``)."""
    physical = m.div.filter("kind = 'PHYSICAL'").select("mets", F.col("div_id").alias("to_id"))
    pages = m.fptr.select("mets", F.col("div_id").alias("to_id"), "file_id").join(physical, ["mets", "to_id"], "left_semi")
    files = m.file.filter("file_id IS NOT NULL").select("mets", "file_id", "href").distinct()
    links = m.link.select("mets", "from_id", "to_id", F.col("ord").alias("link_ord"))
    return links.join(logical, ["mets", "from_id"]).join(pages, ["mets", "to_id"]).join(files, ["mets", "file_id"])


def file_dmdids(m: Mets) -> DataFrame:
    """(mets, href, ord, dmdids): the last structural link decides, else the file, else its group."""
    logical = m.div.filter("kind = 'LOGICAL' AND trim(dmdid) <> ''").select("mets", F.col("div_id").alias("from_id"), F.col("dmdid").alias("link_dmdid"))
    last = _linked(m, logical).groupBy("mets", "href").agg(F.max(F.struct("link_ord", "link_dmdid")).alias("l"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    own = m.file.withColumn("d", F.coalesce(blank("file_dmdid"), blank("grp_dmdid")))
    # A href that stands twice keeps its first place and takes its last DMDIDs.
    own = own.groupBy("mets", "href").agg(F.min("ord").alias("ord"), F.max(F.when(F.col("d").isNotNull(), F.struct("ord", "d"))).alias("o"))
    out = own.join(last, ["mets", "href"], "left").withColumn("d", F.coalesce("l.link_dmdid", "o.d"))
    return out.filter("d IS NOT NULL").select("mets", "href", "ord", F.split(F.trim("d"), r"\s+").alias("dmdids"))


def joined_values(mods: DataFrame, *by: str) -> DataFrame:
    """(by, value): the values of each section in document order (``ord``), joined by ``+``; empty ones count as none."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "value")))
    return mods.filter("value <> ''").groupBy(*by).agg(F.array_join(F.transform(ordered, lambda r: r["value"]), "+").alias("value"))


def mods_values(m: Mets, dimension: str) -> DataFrame:
    """(mets, href, ord, value): the first DMDID with values counts; several values are joined by ``+``."""
    per = joined_values(m.mods.filter(F.col("dimension") == dimension), "mets", "dmdid")
    files = file_dmdids(m).select("mets", "href", "ord", F.posexplode("dmdids").alias("pos", "dmdid"))
    return files.join(per, ["mets", "dmdid"]).groupBy("mets", "href", "ord").agg(F.min_by("value", "pos").alias("value"))


def div_values(m: Mets, attribute: str) -> DataFrame:
    """(mets, href, ord, value) of an attribute of logical divs.

    The first linked div that has the attribute counts; else the first div that carries one of the
    DMDIDs of the file or its group.
    """
    value = F.col("attrs")[attribute.upper()]
    divs = m.div.filter("kind = 'LOGICAL'").withColumn("value", F.nullif(value, F.lit(""))).filter("value IS NOT NULL")
    linked = _linked(m, divs.select("mets", F.col("div_id").alias("from_id"), "value")).groupBy("mets", "href").agg(F.min_by("value", "link_ord").alias("by_link"))
    w = W.partitionBy("mets", "d").orderBy("ord")
    carried = divs.select("mets", "ord", "value", F.explode(F.split(F.trim("dmdid"), r"\s+")).alias("d")).withColumn("n", F.row_number().over(w)).filter("n = 1")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    asked = m.file.select("mets", "href", F.posexplode(F.split(F.coalesce(blank("file_dmdid"), blank("grp_dmdid")), r"\s+")).alias("pos", "d"))
    by_dmd = asked.join(carried.select("mets", "d", "value"), ["mets", "d"]).groupBy("mets", "href").agg(F.min_by("value", "pos").alias("by_dmd"))
    files = m.file.groupBy("mets", "href").agg(F.min("ord").alias("ord"))
    out = files.join(linked, ["mets", "href"], "left").join(by_dmd, ["mets", "href"], "left").withColumn("value", F.coalesce("by_link", "by_dmd"))
    return out.filter("value IS NOT NULL").select("mets", "href", "ord", "value")


def with_metadata(entries: DataFrame, m: Mets, specs: list[str]) -> DataFrame:
    """Entries with a column per ``mods:…`` and ``mets:…`` spec, joined over their reference's href."""
    from ..operators.pairing import match_hrefs

    for spec in specs:
        kind, _, rest = spec.partition(":")
        if kind == "mods":
            name = rest if rest.startswith(".//") else rest.partition(":")[0]
            column, values = f"mods_{name}", mods_values(m, name)
            known = file_dmdids(m)
        elif kind == "mets":
            column, values = f"mets_div_{rest.lower()}", div_values(m, rest)
            known = values
        else:
            continue
        if column in entries.columns:
            continue
        entries = cut(entries)  # its plan is used twice below, so that it would double with every key
        own = ["mets"] if "mets" in entries.columns else []
        asked = entries.select(*own, "path_groundtruth").distinct().filter("path_groundtruth IS NOT NULL")
        paired = match_hrefs(asked, known.select("mets", "href", "ord")).filter("href IS NOT NULL")
        got = paired.join(values.select("mets", "href", F.col("value").alias(column)), ["mets", "href"]).select(*own, "path_groundtruth", column)
        entries = entries.join(got, [*own, "path_groundtruth"], "left")
    return entries


def coverage(entries: DataFrame, m: Mets) -> DataFrame:
    """(kind, name): how evaluation entries (``path_groundtruth``) and the full-text references of METS files
    meet. Kinds: ``mapped`` and ``missing`` entries, ``represented`` and ``unused`` references (each href of
    a METS file once)."""
    from ..operators.pairing import href_matches

    asked = entries.select("path_groundtruth").distinct().filter("path_groundtruth IS NOT NULL")
    refs = fulltext_refs(m.file).select("mets", "href", "ord").distinct()
    met = cut(href_matches(asked, refs))
    kind = lambda k, df, c: df.select(F.lit(k).alias("kind"), F.col(c).alias("name"))
    hrefs = refs.select("mets", "href").distinct()
    return (
        kind("mapped", asked.join(met, "path_groundtruth", "left_semi"), "path_groundtruth").unionByName(kind("missing", asked.join(met, "path_groundtruth", "left_anti"), "path_groundtruth"))
        .unionByName(kind("represented", hrefs.join(met, ["mets", "href"], "left_semi"), "href")).unionByName(kind("unused", hrefs.join(met, ["mets", "href"], "left_anti"), "href"))
    )


def coverage_lines(report: DataFrame, names: bool = False) -> list[str]:
    """``coverage`` as lines of text: its four counts, what is missing on either side, and with ``names`` which."""
    n = {r["kind"]: r["count"] for r in report.groupBy("kind").count().collect()}
    count = lambda k: n.get(k, 0)
    out = [
        f"METS coverage: {count('mapped')}/{count('mapped') + count('missing')} evaluation items map to "
        f"{count('represented')}/{count('represented') + count('unused')} full-text file references"
    ]
    if count("missing"):
        out.append(f"{count('missing')} evaluation items are not represented by a METS full-text reference")
    if count("unused"):
        out.append(f"{count('unused')} METS full-text references have no evaluation item and are not counted")
    if names:
        said = {"missing": "evaluation item not in METS", "unused": "METS reference not evaluated"}
        out += [f"{said[r['kind']]}: {r['name']}" for r in report.filter(F.col("kind").isin(*said)).orderBy("kind", "name").toLocalIterator()]
    return out


def select_hrefs(m: Mets, filters: list[str]) -> DataFrame:
    """Hrefs of full texts that satisfy all ``mods:…=…`` and ``mets:…=…`` filters, in document order."""
    from ..operators.filters import Filter, apply_filters
    from ..operators.grouping import type_of_name, with_entry_columns

    refs = fulltext_refs(m.file).groupBy("mets", "href").agg(F.min("ord").alias("ord"))
    entries = refs.select("mets", "ord", F.col("href").alias("path_groundtruth"), F.col("href").alias("path_candidate"), F.lit("").alias("root"))
    entries = with_entry_columns(entries.withColumn("gt_type", type_of_name(F.element_at(F.split("path_groundtruth", "/"), -1))))
    entries = with_metadata(entries, m, [f.partition("=")[0].strip() for f in filters])
    return apply_filters(entries, [Filter.parse(f) for f in filters]).select("mets", "ord", F.col("path_groundtruth").alias("href")).orderBy("mets", "ord")
