"""Boxes, polygons and frames of page pieces as column expressions.

A polygon is an array of (x, y) structs. Whether a word lies in a frame is decided by its centroid:
first by the frame's box, which is exact for rectangles, and only inside the box by the edges of the
frame's convex hull. A centroid on the border is outside.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = r"\A\s*-?\d+(?:\.\d+)?,-?\d+(?:\.\d+)?(?:\s+-?\d+(?:\.\d+)?,-?\d+(?:\.\d+)?)+\s*\z"
POLYGON = "array<struct<x:double,y:double>>"


def is_point_list(text: Column) -> Column:
    """Whether a text holds two or more points ``x,y``."""
    return text.rlike(POINTS)


def polygon(text: Column) -> Column:
    """``x,y x,y …`` as a polygon; two points are opposite corners of a box. Null if it is no point list."""
    pts = F.transform(
        F.split(F.regexp_replace(text, r"\A\s+|\s+\z", ""), r"\s+"),
        lambda p: F.struct(F.split_part(p, F.lit(","), F.lit(1)).try_cast("double").alias("x"), F.split_part(p, F.lit(","), F.lit(2)).try_cast("double").alias("y")),
    )
    b = box(pts)
    corners = box_polygon(b["minx"], b["miny"], b["maxx"], b["maxy"])
    return F.when(is_point_list(text), F.when(F.size(pts) == 2, corners).otherwise(pts))


def parse_polygon(text: str) -> list[tuple[float, float]]:
    """``polygon`` for one text on the driver; a ValueError if it is no point list."""
    if not re.fullmatch(POINTS[2:-2], text):
        raise ValueError(f"no list of points: {text!r}")
    pts = [tuple(map(float, p.split(","))) for p in text.split()]
    if len(pts) == 2:
        (a, b), (c, d) = pts
        x0, x1, y0, y1 = min(a, c), max(a, c), min(b, d), max(b, d)
        pts = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return pts


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The four corners of a box, clockwise from the upper left."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))


def box(poly: Column) -> Column:
    """Struct (minx, miny, maxx, maxy) of a polygon's vertices."""
    side = lambda f, c: f(F.transform(poly, lambda p: p[c]))
    return F.struct(side(F.array_min, "x").alias("minx"), side(F.array_min, "y").alias("miny"), side(F.array_max, "x").alias("maxx"), side(F.array_max, "y").alias("maxy"))


def point_list(poly: Column) -> Column:
    """A polygon as ``x,y x,y …`` in whole numbers."""
    return F.array_join(F.transform(poly, lambda p: F.concat(F.bround(p["x"], 0).cast("bigint").cast("string"), F.lit(","), F.bround(p["y"], 0).cast("bigint").cast("string"))), " ")


def vertex_mean(poly: Column) -> Column:
    """Struct (x, y): the mean of the vertices; null without vertices."""
    mean = lambda c: F.aggregate(poly, F.lit(0.0), lambda a, p: a + p[c]) / F.nullif(F.size(poly), F.lit(0))
    return F.when(F.size(poly) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def centroid(poly: Column) -> Column:
    """Struct (x, y): the centre of the polygon's area; the mean of its vertices where it has none.

    Boxes of four corners in order, as most words have, need no sum over edges.
    """
    n, at = F.size(poly), lambda i, c: F.get(poly, F.lit(i))[c]
    turned = [(at(0, a) == at(1, a)) & (at(2, a) == at(3, a)) & (at(1, b) == at(2, b)) & (at(3, b) == at(0, b)) for a, b in (("x", "y"), ("y", "x"))]
    boxed = (n == 4) & (turned[0] | turned[1])
    middle = F.struct(((at(0, "x") + at(2, "x")) / 2).alias("x"), ((at(0, "y") + at(2, "y")) / 2).alias("y"))
    edges = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(poly, i).alias("p"), F.get(poly, (i + 1) % F.greatest(n, F.lit(1))).alias("q")))
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    total = lambda f: F.aggregate(edges, F.lit(0.0), lambda a, e: a + f(e))
    area2 = F.nullif(total(cross), F.lit(0.0))
    mean = lambda c: total(lambda e: (e["p"][c] + e["q"][c]) * cross(e)) / (3 * area2)
    flat = vertex_mean(poly)
    return F.when(boxed, middle).when(n > 0, F.struct(F.coalesce(mean("x"), flat["x"]).alias("x"), F.coalesce(mean("y"), flat["y"]).alias("y")))


def convex_hull(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise in a system whose y points up, without points on its edges."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(ps: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def in_frame(point: Column, frame: Sequence[tuple[float, float]]) -> Column:
    """Whether a point (struct x, y) lies strictly inside the convex hull of a fixed frame."""
    hull = convex_hull(frame)
    if len(hull) < 3:
        return F.lit(False)
    xs, ys = [p[0] for p in hull], [p[1] for p in hull]
    inside = (point["x"] > min(xs)) & (point["x"] < max(xs)) & (point["y"] > min(ys)) & (point["y"] < max(ys))
    if set(hull) == {(x, y) for x in (min(xs), max(xs)) for y in (min(ys), max(ys))}:
        return inside
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
        inside = inside & ((bx - ax) * (point["y"] - ay) > (by - ay) * (point["x"] - ax))
    return inside


def in_box(point: Column, frame: Column) -> Column:
    """Whether a point lies strictly inside a box given as a struct column."""
    return (point["x"] > frame["minx"]) & (point["x"] < frame["maxx"]) & (point["y"] > frame["miny"]) & (point["y"] < frame["maxy"])


LEVELS = {"page": 7, "table": 6, "region": 5, "cell": 4, "line": 3, "word": 2, "glyph": 1}


def words_in_frame(pieces: DataFrame, frame: Sequence[tuple[float, float]]) -> DataFrame:
    """Pieces without the words whose centroid lies outside the frame; pages without words stay whole."""
    keep = (F.col("level") != "word") | in_frame(centroid(F.col("poly")), frame)
    return pieces.filter(keep)


def words_in_boxes(pieces: DataFrame, boxes: DataFrame, key: str = "path") -> DataFrame:
    """Pieces without the words whose centroid lies outside their page's own box.

    ``boxes`` has one row per page (key, box); a page without a box, or with a null one, stays whole.
    """
    b = boxes.select(key, F.col("box").alias("_box"))
    inside = in_box(centroid(F.col("poly")), F.col("_box"))
    return pieces.join(b, key, "left").filter((F.col("level") != "word") | F.col("_box").isNull() | inside).drop("_box")


def boxes_of(pieces: DataFrame, *by: str) -> DataFrame:
    """(by, minx, miny, maxx, maxy): the box around the polygons of each group."""
    b = pieces.select(*by, box(F.col("poly")).alias("_b"))
    return b.groupBy(*by).agg(F.min("_b.minx").alias("minx"), F.min("_b.miny").alias("miny"), F.max("_b.maxx").alias("maxx"), F.max("_b.maxy").alias("maxy"))


def ancestors(pieces: DataFrame, key: str = "path") -> DataFrame:
    """(key, piece_id, parent): each word with every piece above it but the page, by the pieces' ``parent_id``.

    A page has few levels, so the chain is followed by at most four joins of a page's pieces.
    """
    up = pieces.select(key, "piece_id", "parent_id", "level")
    step = up.filter("level = 'word'").select(key, "piece_id", F.col("parent_id").alias("parent"))
    above = up.filter("level NOT IN ('word', 'page')").select(key, F.col("piece_id").alias("parent"), F.col("parent_id").alias("next"))
    out = None
    for _ in range(4):
        step = step.join(above, [key, "parent"])
        here = step.select(key, "piece_id", "parent")
        out = here if out is None else out.unionByName(here)
        step = step.select(key, "piece_id", F.col("next").alias("parent"))
    return out


def cut_to_frame(pieces: DataFrame, frame: Sequence[tuple[float, float]], key: str = "path", parents_of: DataFrame | None = None) -> DataFrame:
    """``pieces`` cut down to a frame: words outside fall away, lines and regions without words as well,
    and what stays shrinks to the box of its words. The page itself stays as it is.

    Glyphs are not supported: their presence is an error. Words carry the ids of their line and region, so
    words are rolled up to lines and lines to regions; with ``parents_of`` (see ``ancestors``) all
    levels above the words are, also regions inside regions and tables.
    """
    p = pieces.withColumn("poly", F.when(F.col("level") == "glyph", F.raise_error(F.lit("pieces below words are not supported")).cast(POLYGON)).otherwise(F.col("poly")))
    words = words_in_frame(p.filter("level = 'word'"), frame)
    if parents_of is None:
        chain = words.filter("line_id IS NOT NULL")
        lines = boxes_of(chain, key, "line_id", "region_id")
        above = [("line", lines, "line_id"), ("region", lines.withColumn("poly", _corners_of()).transform(boxes_of, key, "region_id"), "region_id")]
    else:
        above = [(level, boxes_of(words.join(parents_of, [key, "piece_id"]), key, "parent"), "parent") for level in ("line", "cell", "region", "table")]

    def shrunk(level: str, boxes: DataFrame, named: str) -> DataFrame:
        rows = p.filter(F.col("level") == level).join(boxes.filter(F.col(named).isNotNull()).select(key, F.col(named).alias("piece_id"), _corners_of().alias("_poly")), [key, "piece_id"])
        return rows.withColumn("poly", F.col("_poly")).select(*pieces.columns)

    out = p.filter("level = 'page'").unionByName(words.select(*pieces.columns))
    for part in above:
        out = out.unionByName(shrunk(*part))
    return out


def _corners_of() -> Column:
    return box_polygon(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))


def change_log(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """Per level how many pieces were removed and how many changed their polygon."""
    b = before.select(key, "level", "piece_id", point_list(F.col("poly")).alias("was"))
    a = after.select(key, "piece_id", point_list(F.col("poly")).alias("is"), F.lit(True).alias("there"))
    j = b.join(a, [key, "piece_id"], "left")
    change = F.when(F.col("there").isNull(), "removed").when(F.col("was") != F.col("is"), "resized")
    return j.withColumn("change", change).filter("change IS NOT NULL").groupBy("level", "change").agg(F.count("*").alias("n"))
