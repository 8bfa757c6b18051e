"""Layout XML: files cut down to a frame, pieces written as new files, and where results go.

``framed_files`` edits the files themselves, so that all they hold beside the cut words stays. ``to_xml``
makes new files of pieces; those have the pieces' structure and nothing else.
"""

from __future__ import annotations

import os
import xml.dom.minidom as minidom
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.geometry import box, convex_hull, point_list
from .files import save

ALTO = "http://www.loc.gov/standards/alto/ns-v3#"
PAGE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"


def _alto(rows: pd.DataFrame) -> ET.Element:
    def at(e: ET.Element, r) -> ET.Element:
        for name, v in zip(("HPOS", "VPOS", "WIDTH", "HEIGHT"), (r.minx, r.miny, r.maxx - r.minx, r.maxy - r.miny), strict=True):
            e.set(name, str(round(v)))
        return e

    page = rows[rows["level"] == "page"].iloc[0]
    root = ET.Element("alto", xmlns=ALTO)
    p = ET.SubElement(ET.SubElement(root, "Layout"), "Page", ID=page.piece_id, WIDTH=str(round(page.maxx)), HEIGHT=str(round(page.maxy)))
    space = at(ET.SubElement(p, "PrintSpace"), page)
    lines = rows[rows["level"] == "line"].sort_values("line_ord")
    for region in rows[(rows["level"] == "region")].sort_values("region_ord").itertuples():
        own = lines[lines["region_id"] == region.piece_id]
        if own.empty:
            continue
        block = at(ET.SubElement(space, "TextBlock", ID=region.piece_id), region)
        for line in own.itertuples():
            tl = at(ET.SubElement(block, "TextLine", ID=line.piece_id), line)
            words = rows[(rows["level"] == "word") & (rows["line_id"] == line.piece_id)].sort_values("word_ord")
            for k, w in enumerate(words.itertuples()):
                if k:
                    ET.SubElement(tl, "SP")
                at(ET.SubElement(tl, "String", ID=w.piece_id, CONTENT=w.text), w)
            if words.empty and line.text:
                at(ET.SubElement(tl, "String", ID=f"{line.piece_id}_0", CONTENT=line.text), line)
    return root


def _page(rows: pd.DataFrame) -> ET.Element:
    page = rows[rows["level"] == "page"].iloc[0]
    root = ET.Element("PcGts", xmlns=PAGE)
    # A piece knows neither the image's name nor its size; the page's polygon is that of its regions.
    p = ET.SubElement(root, "Page", id=page.piece_id, imageFilename="", imageWidth=str(round(page.maxx)), imageHeight=str(round(page.maxy)))

    def add(parent: ET.Element, tag: str, r) -> ET.Element:
        e = ET.SubElement(parent, tag, id=r.piece_id)
        ET.SubElement(e, "Coords", points=r.points)
        return e

    for region in rows[rows["level"] == "region"].sort_values("region_ord").itertuples():
        block = add(p, "TextRegion", region)
        for line in rows[(rows["level"] == "line") & (rows["region_id"] == region.piece_id)].sort_values("line_ord").itertuples():
            tl = add(block, "TextLine", line)
            for w in rows[(rows["level"] == "word") & (rows["line_id"] == line.piece_id)].sort_values("word_ord").itertuples():
                ET.SubElement(ET.SubElement(add(tl, "Word", w), "TextEquiv"), "Unicode").text = w.text
            if line.text:
                ET.SubElement(ET.SubElement(tl, "TextEquiv"), "Unicode").text = line.text
    return root


def to_xml(pieces: DataFrame) -> DataFrame:
    """(path, xml): each page's pieces as one document of its format."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        root = (_alto if rows["format"].iloc[0] == "alto" else _page)(rows)
        ET.indent(root)
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "xml": ["<?xml version='1.0' encoding='UTF-8'?>\n" + ET.tostring(root, encoding="unicode")]})

    b = box(F.col("poly"))
    flat = pieces.filter("error IS NULL").select("path", "format", "level", "piece_id", "region_id", "line_id", "region_ord", "line_ord", "word_ord", "text",
                                                 point_list(F.col("poly")).alias("points"), b["minx"].alias("minx"), b["miny"].alias("miny"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"))
    return flat.groupBy("path").applyInPandas(build, "path string, xml string")


def default_name(path: str) -> str:
    """``page.gt.xml`` beside ``page.xml``."""
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}.gt.{suffix}" if dot else f"{path}.gt"


def write_xml(documents: DataFrame, folder: str | None = None) -> None:
    """Writes each document (path, xml) beside its source as ``<stem>.gt<suffix>``, or under its name in ``folder``."""

    def write(rows) -> None:
        for r in rows:
            save(default_name(r["path"]) if folder is None else f"{folder.rstrip('/')}/{os.path.basename(r['path'])}", r["xml"].encode())

    documents.foreachPartition(write)


_WORDS, _LINE = {"String", "Word"}, "TextLine"
_HOLDERS = {"TextLine", "TextBlock", "ComposedBlock", "TextRegion", "TableCell", "TableRegion"}


def _name(node: minidom.Node) -> str:
    return node.nodeName.rpartition(":")[2]


def _elements(node: minidom.Node) -> list:
    return [c for c in node.childNodes if c.nodeType == minidom.Node.ELEMENT_NODE]


def _points(e: minidom.Element) -> list[tuple[float, float]]:
    """The corners of an ALTO element's box, or the points of a PAGE element."""
    if e.hasAttribute("HPOS"):
        x, y, w, h = (float(e.getAttribute(a)) for a in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    coords = next(c for c in _elements(e) if _name(c) == "Coords")
    return [tuple(map(float, p.split(","))) for p in coords.getAttribute("points").split()]


def _middle(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Centre of the area; the mean of the points where it has none."""
    pairs = list(zip(points, points[1:] + points[:1], strict=True))
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs)
    if not area:
        return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)
    return tuple(sum((a[i] + b[i]) * (a[0] * b[1] - b[0] * a[1]) for a, b in pairs) / (3 * area) for i in (0, 1))


class _Cut:
    """One file cut down to the convex hull of a frame."""

    def __init__(self, frame: Sequence[tuple[float, float]]):
        hull = convex_hull(frame)
        self.edges = list(zip(hull, hull[1:] + hull[:1], strict=True)) if len(hull) > 2 else []
        self.removed, self.resized = Counter(), Counter()

    def inside(self, e: minidom.Element) -> bool:
        x, y = _middle(_points(e))
        return bool(self.edges) and all((b[0] - a[0]) * (y - a[1]) > (b[1] - a[1]) * (x - a[0]) for a, b in self.edges)

    def drop(self, e: minidom.Element) -> None:
        e.parentNode.removeChild(e)
        self.removed[_name(e)] += 1

    def line(self, line: minidom.Element) -> list[list[tuple[float, float]]]:
        """Drops the words of a line that lie outside; the shapes of the others. Strings up to a blank are one word."""
        parts, spaced, word, keep = _elements(line), any(_name(c) == "SP" for c in _elements(line)), None, []
        for e in parts:
            if _name(e) in _WORDS:
                word = self.inside(e) if word is None or not spaced else word
                if word:
                    keep.append(_points(e))
                else:
                    self.drop(e)
            elif _name(e) == "SP":
                word = None
            elif _name(e) == "HYP" and word is False:
                self.drop(e)
        # Blanks stay between words only.
        last = None
        for e in [x for x in _elements(line) if _name(x) in ("String", "SP")]:
            if _name(e) == "SP" and (last is None or _name(last) == "SP"):
                self.drop(e)
            else:
                last = e
        if last is not None and _name(last) == "SP":
            self.drop(last)
        return keep

    def visit(self, e: minidom.Element) -> list[list[tuple[float, float]]] | None:
        """The shapes of the words left below an element; null if no line is part of it."""
        if _name(e) == _LINE:
            left = self.line(e)
        else:
            below = [x for x in (self.visit(c) for c in _elements(e)) if x is not None]
            left = [p for x in below for p in x] if below else None
        if left is None or _name(e) not in _HOLDERS:
            return left
        if not left:
            self.drop(e)
        else:
            self.resize(e, left)
        return left

    def resize(self, e: minidom.Element, shapes: list[list[tuple[float, float]]]) -> None:
        xs, ys = [p[0] for s in shapes for p in s], [p[1] for s in shapes for p in s]
        x0, y0, x1, y1 = min(xs), min(ys), max(xs), max(ys)
        coords = next((c for c in _elements(e) if _name(c) == "Coords"), None)
        if coords is not None:
            new = {"points": " ".join(f"{round(x)},{round(y)}" for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)))}
        else:
            new = {"HPOS": int(x0), "VPOS": int(y0), "WIDTH": int(x1 - x0), "HEIGHT": int(y1 - y0)}
        at, changed = coords if coords is not None else e, False
        for name, value in new.items():
            if at.hasAttribute(name) and at.getAttribute(name) != str(value):
                at.setAttribute(name, str(value))
                changed = True
        self.resized[_name(e)] += changed


def framed_files(rows: DataFrame, frame: Sequence[tuple[float, float]]) -> DataFrame:
    """(path, xml, removed, resized, error): the files of ``rows`` (path, content) cut down to a frame.

    Words whose centroid lies outside the frame's convex hull go, lines, regions, cells and tables without
    words as well, and what stays shrinks to the box of its words. Everything else in a file (order,
    styles, tags, confidences, pictures, other pages) stays. ``removed`` and ``resized`` count by element
    name. A file that is no layout file or has broken numbers has no ``xml`` but an ``error``.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    doc, work = minidom.parseString(bytes(content or b"")), _Cut(frame)
                    if _name(doc.documentElement).lower() not in ("alto", "pcgts"):
                        raise ValueError(f"unknown root element {doc.documentElement.nodeName}")
                    work.visit(doc.documentElement)
                    resized = {k: v for k, v in work.resized.items() if v}
                    out.append((path, doc.toxml(encoding="UTF-8").decode(), dict(work.removed), resized, None))
                except Exception as e:  # noqa: BLE001 - a broken file must not end the others
                    out.append((path, None, {}, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "xml", "removed", "resized", "error"])

    return rows.select("path", "content").mapInPandas(cut, "path string, xml string, removed map<string,int>, resized map<string,int>, error string")
