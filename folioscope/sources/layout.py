"""ALTO, PAGE and plain-text files as flat pieces.

Files come as rows (path, content) of Spark's ``binaryFile`` source. Each is parsed once, inside
``mapInPandas``, into pieces: page, regions, lines and words with their order, text and polygon. A
file that cannot be read gives one row with ``error`` set instead, so that one bad file does not stop
the others.

The rules of both formats: the first page of an ALTO file counts; where a line has blanks (SP)
between its Strings, the Strings up to a blank form one word with the id and box of the first;
TextBlocks without lines and lines without Strings fall away. A PAGE file has one page; regions are
the TextRegions and then the TableCells, in the reading order's sequence; of several texts of an
element the one with the least index, compared as a string, counts; words take the place of the
line's own text; a page polygon is made of its regions' vertices.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..operators.geometry import POLYGON

PIECES = (
    "path string, format string, level string, piece_id string, parent_id string, region_id string, line_id string, region_ord int, line_ord int, "
    f"word_ord int, text string, poly {POLYGON}, subject string, error string"
)
_COLUMNS = [c.split(" ", 1)[0] for c in re.split(r", (?![^<]*>)", PIECES)]


class LayoutError(Exception):
    """A file that is no layout file, or one that breaks the rules of its format."""


class BrokenLayout(LayoutError):
    """A layout file that breaks the rules of its format."""

    def __init__(self, kind: str, why: str):
        super().__init__(why)
        self.kind = kind


def files(spark: SparkSession, folder: str, pattern: str = "*.xml", recursive: bool = True) -> DataFrame:
    """(path, content) of the files below a folder."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select(F.regexp_replace("path", r"\Afile:/*(?=/)", "").alias("path"), "content")


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if x is not e and _tag(x) == name]


def sniff(content: bytes) -> tuple[str, ET.Element]:
    """The format (``alto`` or ``page``) and the root element; a LayoutError for anything else."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise LayoutError(f"no XML: {e}") from e
    name, space = _tag(root), root.tag.partition("}")[0].lstrip("{")
    if name == "alto":
        return "alto", root
    if name.lower() == "pcgts" or "PAGE/gts/pagecontent" in space:
        return "page", root
    raise LayoutError(f"unknown root element {name}")


def _piece(**values) -> dict:
    return {c: None for c in _COLUMNS} | values


def _corners(e: ET.Element) -> list[dict] | None:
    """The four corners of an element; null where it has no box."""
    if any(e.get(a) is None for a in ("HPOS", "VPOS", "WIDTH", "HEIGHT")):
        return None
    x, y, w, h = (int(float(e.get(a))) for a in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def _page_box(e: ET.Element, width: str, height: str) -> list[dict]:
    w, h = float(int(e.get(width))), float(int(e.get(height)))
    return [{"x": a, "y": b} for a, b in ((0.0, 0.0), (w, 0.0), (w, h), (0.0, h))]


def _alto_words(line: ET.Element) -> list[tuple[ET.Element, str]]:
    strings = _all(line, "String")
    if not any(_tag(x) == "SP" for x in line):
        return [(s, s.get("CONTENT", "")) for s in strings if s.get("CONTENT", "").strip()]
    words, open_ = [], False
    for x in line:
        if _tag(x) == "SP":
            open_ = False
        elif _tag(x) == "String" and x.get("CONTENT", "").strip():
            if open_:
                words[-1] = (words[-1][0], words[-1][1] + x.get("CONTENT"))
            else:
                words.append((x, x.get("CONTENT")))
            open_ = True
    return words


def _alto_subject(root: ET.Element) -> str | None:
    tags = _all(root, "OtherTag")
    if not tags:
        return None
    if tags[0].get("LABEL"):
        return tags[0].get("LABEL")
    typed = [t for t in tags if t.get("ID") == "ulb_groundtruth_type"]
    return typed[0].get("VALUE") or None if len(typed) == 1 else None


def alto_pieces(root: ET.Element) -> Iterator[dict]:
    """Pieces of the first page of an ALTO file."""
    pages = _all(root, "Page")
    if not pages:
        raise LayoutError("no page")
    page = pages[0]
    pid = page.get("ID") or "page"
    yield _piece(level="page", piece_id=pid, poly=_page_box(page, "WIDTH", "HEIGHT"), subject=_alto_subject(root))
    composed = _all(root, "ComposedBlock")
    groups = [(c, _all(c, "TextBlock")) for c in composed] or [(None, _all(root, "TextBlock"))]
    if any(not blocks for _, blocks in groups):
        raise LayoutError("no blocks")
    r = n = 0
    for outer, blocks in groups:
        above = pid
        if outer is not None:
            above = outer.get("ID") or f"cb{r}"
            yield _piece(level="region", piece_id=above, parent_id=pid, region_id=above, region_ord=r, poly=_corners(outer))
            r += 1
        for block in blocks:
            lines = [t for t in _all(block, "TextLine") if _all(t, "String")]
            if not lines:
                continue
            rid = block.get("ID") or f"tb{r}"
            yield _piece(level="region", piece_id=rid, parent_id=above, region_id=rid, region_ord=r, poly=_corners(block))
            for line in lines:
                lid = line.get("ID") or f"tl{n}"
                at = {"region_id": rid, "line_id": lid, "region_ord": r, "line_ord": n}
                yield _piece(level="line", piece_id=lid, parent_id=rid, poly=_corners(line), **at)
                for k, (s, text) in enumerate(_alto_words(line)):
                    yield _piece(level="word", piece_id=s.get("ID") or f"{lid}_{k}", parent_id=lid, word_ord=k, text=text, poly=_corners(s), **at)
                n += 1
            r += 1


def _page_points(e: ET.Element) -> list[dict]:
    coords = next((c for c in e if _tag(c) == "Coords"), None)
    points = (coords.get("points") or "").split() if coords is not None else []
    try:
        poly = [{"x": float(int(a)), "y": float(int(b))} for a, b in (p.split(",") for p in points)]
    except ValueError as err:
        raise LayoutError(f"bad points at {_tag(e)}@ID={e.get('id')}") from err
    if len(poly) < 3:
        raise LayoutError(f"fewer than three points at {_tag(e)}@ID={e.get('id')}")
    return poly


def _page_text(e: ET.Element) -> str | None:
    found = []
    for eq in (c for c in e if _tag(c) == "TextEquiv"):
        u = next((c for c in eq if _tag(c) == "Unicode"), None)
        text = "".join(u.itertext()) if u is not None else ""
        if text.strip():
            found.append((eq.get("index") or "", text.replace("\n", " ").strip()))
    return min(found, key=lambda t: t[0])[1] if found else None


def _reading_order(page: ET.Element) -> dict[str, int]:
    order: dict[str, int] = {}
    groups = _all(page, "ReadingOrder")
    for ref in _all(groups[0], "RegionRefIndexed") if groups else []:
        try:
            order.setdefault(ref.get("regionRef"), int(ref.get("index")))
        except (TypeError, ValueError):
            continue
    return order


def page_pieces(root: ET.Element, skip_lines: bool = False) -> Iterator[dict]:
    """Pieces of a PAGE file; with ``skip_lines`` lines without words whose polygon is missing or broken fall away."""
    pages = _all(root, "Page")
    if len(pages) != 1:
        raise LayoutError(f"{len(pages)} pages instead of one")
    page = pages[0]
    pid, order = page.get("id") or page.get("imageFilename") or "page", _reading_order(page)
    regions, out, hull = _all(page, "TextRegion") + _all(page, "TableCell"), [], []
    listed = sorted(range(len(regions)), key=lambda i: (order.get(regions[i].get("id"), len(regions) + len(order) + 1_000_000), i))
    n = 0
    for r, i in enumerate(listed):
        region = regions[i]
        lines = _all(region, "TextLine")
        if not lines:
            continue
        rid, kept = region.get("id") or f"r{i}", []
        poly = _page_points(region)
        for line in lines:
            lid, words = line.get("id") or f"l{n}", []
            try:
                lpoly, own = _page_points(line), _page_text(line)
            except LayoutError:
                if skip_lines and not _all(line, "Word"):
                    continue
                raise
            multiple = sum(1 for c in line if _tag(c) == "TextEquiv") > 1
            at = {"region_id": rid, "line_id": lid, "region_ord": r, "line_ord": n}
            for k, w in enumerate([] if multiple and own else _all(line, "Word")):
                words.append(_piece(level="word", piece_id=w.get("id") or f"{lid}_{k}", parent_id=lid, word_ord=k, text=_page_text(w), poly=_page_points(w), **at))
            if any(w["text"] is None for w in words):
                raise LayoutError(f"a word without text in line {lid}")
            kept.append(_piece(level="line", piece_id=lid, parent_id=rid, text=None if words else own, poly=lpoly, **at))
            kept += words
            n += 1
        if kept:
            hull += poly
            out.append(_piece(level="region", piece_id=rid, parent_id=pid, region_id=rid, region_ord=r, poly=poly, subject=region.get("type")))
            out += kept
    yield _piece(level="page", piece_id=pid, poly=hull or _page_box(page, "imageWidth", "imageHeight"))
    yield from out


def read_content(content: bytes, skip_lines: bool = False) -> tuple[str, list[dict]]:
    """Format and pieces of one file."""
    kind, root = sniff(content)
    try:
        return kind, list(alto_pieces(root) if kind == "alto" else page_pieces(root, skip_lines))
    except (LayoutError, TypeError, ValueError) as e:
        raise BrokenLayout(kind, str(e) if isinstance(e, LayoutError) else f"bad number: {e}") from e


def read_pieces(rows: DataFrame, skip_lines: bool = False) -> DataFrame:
    """Pieces of all files in ``rows`` (path, content); unreadable files have one row with ``error``, and with
    ``format`` if they are layout files that break its rules. ``skip_lines``: see ``page_pieces``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    kind, pieces = read_content(bytes(content or b""), skip_lines)
                    out = [p | {"path": path, "format": kind} for p in pieces]
                except LayoutError as e:
                    out = [_piece(path=path, error=str(e), format=getattr(e, "kind", None))]
                frame = pd.DataFrame(out, columns=_COLUMNS)
                for c in ("region_ord", "line_ord", "word_ord"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    return rows.select("path", "content").mapInPandas(parse, PIECES)


def line_texts(pieces: DataFrame) -> DataFrame:
    """(path, region_ord, line_ord, text): a line's words in order, else its own text."""
    lines = pieces.filter("level IN ('line', 'word')").groupBy("path", "region_ord", "line_ord").agg(
        F.max(F.when(F.col("level") == "line", F.col("text"))).alias("own"),
        F.array_sort(F.collect_list(F.when(F.col("level") == "word", F.struct("word_ord", "text")))).alias("words"),
    )
    text = F.when(F.size("words") > 0, F.array_join(F.transform("words", lambda w: w["text"]), " ")).otherwise(F.coalesce("own", F.lit("")))
    return lines.select("path", "region_ord", "line_ord", text.alias("text"))


def page_texts(pieces: DataFrame) -> DataFrame:
    """(path, text, n_lines): the lines of a page in reading order, joined by blanks."""
    lines = line_texts(pieces).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("region_ord", "line_ord", "text"))).alias("ls"))
    return lines.select("path", F.array_join(F.transform("ls", lambda r: r["text"]), " ").alias("text"), F.size("ls").alias("n_lines"))


def texts_of(rows: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """(path, text): page text of layout files, and the stripped lines of files that are none. Layout files
    that break the rules of their format have no text."""
    pieces = read_pieces(rows) if pieces is None else pieces
    pages = page_texts(pieces.filter("error IS NULL"))
    broken = pieces.filter("error IS NOT NULL AND format IS NULL").select("path")
    plain = rows.join(broken, "path", "left_semi").select("path", one_line(F.decode("content", "UTF-8")).alias("text"))
    empty = pieces.filter("error IS NULL AND level = 'page'").select("path").join(pages, "path", "left_anti").withColumn("text", F.lit(""))
    return pages.select("path", "text").unionByName(plain).unionByName(empty)


def page_dimensions(rows: DataFrame) -> DataFrame:
    """(path, width, height) of the first page element; null where there is none."""
    head = F.regexp_extract(F.decode("content", "UTF-8"), r"<(?:\w+:)?Page\b[^>]*>", 0)
    number = lambda a, b: F.nullif(F.regexp_extract(head, rf'\b(?:{a}|{b})="(\d+)"', 1), F.lit("")).cast("int")
    return rows.select("path", number("WIDTH", "imageWidth").alias("width"), number("HEIGHT", "imageHeight").alias("height"))


def image_names(rows: DataFrame) -> DataFrame:
    """(path, image_name): the file name of the image that a PAGE file stands for; null for other files."""
    name = F.regexp_extract(F.decode("content", "UTF-8"), r'<(?:\w+:)?Page\b[^>]*\bimageFilename="([^"]*)"', 1)
    return rows.select("path", F.nullif(F.regexp_extract(name, r"[^/\\]*\z", 0), F.lit("")).alias("image_name"))


def name_box(path: Column) -> Column:
    """The box that a file name ends with, as ``_100x200_300x400``; null without one."""
    m = lambda i: F.regexp_extract(path, r"_(\d{2,})x(\d{2,})_(\d{2,})x(\d{2,})", i).try_cast("double")
    return F.when(m(1).isNotNull(), F.struct(m(1).alias("minx"), m(2).alias("miny"), m(3).alias("maxx"), m(4).alias("maxy")))


def bounding_boxes(rows: DataFrame) -> DataFrame:
    """(path, box, error): the printed area of each file.

    In this order: the file name's box; of ALTO the tag ``ulb_groundtruth_points`` (its first and
    third point), else the box of the Strings that do not start with a digit; of PAGE the lines'
    coordinates, else the border's. Files of other kinds have a null box. A layout file without any of
    these, or with broken numbers, has an ``error``.
    """

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out.append((path, _content_box(bytes(content or b"")), None))
                except (LayoutError, ValueError) as e:  # also numbers that are none
                    out.append((path, None, str(e)))
            yield pd.DataFrame([{"path": p, "found": b, "error": e} for p, b, e in out], columns=["path", "found", "error"])

    kind = "struct<minx:double,miny:double,maxx:double,maxy:double>"
    named = rows.select("path", "content", name_box(F.col("path")).alias("box"))
    read = named.filter("box IS NULL").select("path", "content").mapInPandas(boxes, f"path string, found {kind}, error string")
    return named.filter("box IS NOT NULL").select("path", "box", F.lit(None).cast("string").alias("error")).unionByName(read.select("path", F.col("found").alias("box"), "error"))


def _content_box(content: bytes) -> dict | None:
    try:
        kind, root = sniff(content)
    except LayoutError:
        return None
    if kind == "alto":
        tag = next((t for t in _all(root, "OtherTag") if t.get("ID") == "ulb_groundtruth_points"), None)
        if tag is not None:
            pts = [tuple(map(float, p.split(","))) for p in (tag.get("VALUE") or tag.get("LABEL") or "").split()]
            if len(pts) >= 3:
                return dict(zip(("minx", "miny", "maxx", "maxy"), (*pts[0], *pts[2]), strict=True))
        pts = [c for s in _all(root, "String") if s.get("CONTENT", "").strip() and not s.get("CONTENT")[0].isdecimal() for c in _corners(s) or ()]
    else:
        lines = [c for t in _all(root, "TextLine") for c in _page_points(t)]
        border = [c for b in _all(root, "Border") for c in _page_points(b)]
        pts = lines or border
        if not pts:
            raise LayoutError("neither lines nor a border")
    if not pts:
        raise LayoutError("no words to take the printed area from")
    return {"minx": min(p["x"] for p in pts), "miny": min(p["y"] for p in pts), "maxx": max(p["x"] for p in pts), "maxy": max(p["y"] for p in pts)}
