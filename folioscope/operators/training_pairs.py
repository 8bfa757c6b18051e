"""Lines of a page as pairs of a text and an image part for training recognisers."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pair_prefix, without_marks
from . import images
from .filters import long_enough
from .geometry import point_list, vertex_mean
from .pairing import file_stem
from ..sources.files import save

MANIFEST = "path string, line_id string, text string, name string, written boolean, reason string"


def training_lines(pieces: DataFrame, least: int = 1, right_to_left: bool = False) -> DataFrame:
    """(path, line_id, text, poly, line_ord) of lines with at least ``least`` characters.

    Words stand in order of the x of their centre, whole pixels; ``right_to_left`` reverses them in
    PAGE files. Marks of direction go. Lines without text fall away.
    """
    words = pieces.filter("level = 'word' AND trim(text) <> ''").select(
        "path", "line_id", F.struct(vertex_mean(F.col("poly"))["x"].cast("int").alias("x"), "word_ord", F.trim("text").alias("text")).alias("w"), "format")
    by = words.groupBy("path", "line_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.first("format").alias("format"))
    toks = F.transform("ws", lambda w: without_marks(w["text"]))
    joined = F.array_join(F.when(F.lit(right_to_left) & (F.col("format") == "page"), F.reverse(toks)).otherwise(toks), " ")
    lines = pieces.filter("level = 'line'").select("path", "line_id", "line_ord", "poly", F.col("text").alias("own"))
    out = lines.join(by.select("path", "line_id", joined.alias("joined")), ["path", "line_id"], "left")
    out = out.withColumn("text", F.coalesce("joined", without_marks(F.trim("own")))).drop("joined", "own")
    return out.filter(long_enough(F.col("text"), least))


def with_names(lines: DataFrame) -> DataFrame:
    """Adds the pair's name (``p12_line3``) and the page's prefix (``page12``)."""
    stem = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"\A[^.]*", 0)
    return lines.withColumns({"name": F.concat(pair_prefix(stem, "p"), F.lit("_"), "line_id"), "prefix": pair_prefix(file_stem(F.col("path")), "page")})


def write_pairs(
    lines: DataFrame, image_files: DataFrame, folder: str, sanitize: bool = True, ratio: float | Sequence[float] = 0.1, turn_from: float = 0.1,
    padding: int = 0, binarize: bool = False,
) -> DataFrame:
    """Writes ``<prefix>/<name>.gt.txt`` and ``.tif`` with the page image's resolution below ``folder`` (shared by
    all executors, or with a scheme) and returns the manifest.

    ``image_files`` has (path, image): the page's file and its image as PNG, TIFF, PGM or PPM. A line whose part
    is black or lies outside the image is skipped with a reason. Each page's lines are cut from one
    decoded image.
    """

    def cut(key, rows: pd.DataFrame) -> pd.DataFrame:
        out, page = [], None
        for r in rows.sort_values("line_ord").itertuples():
            reason = None
            try:
                if page is None:
                    page, dpi = images.read_grey(bytes(r.image)), images.dots_per_inch(bytes(r.image))
                shape = [tuple(map(int, p.split(","))) for p in r.points.split()]
                part = images.crop(page, shape)
                if not part.any():
                    raise ValueError("a black part")
                if sanitize:
                    part = images.sanitized(part, shape, ratio, turn_from, padding)
                if binarize:
                    part = images.binarized(part)
                base = f"{folder.rstrip('/')}/{r.prefix}/{r.name}"
                save(f"{base}.tif", images.write_image(part, "tif", dpi))
                save(f"{base}.gt.txt", r.text.encode())
            except ValueError as e:
                reason = str(e)
            out.append((r.path, r.line_id, r.text, r.name, reason is None, reason))
        return pd.DataFrame(out, columns=["path", "line_id", "text", "name", "written", "reason"])

    named = with_names(lines).join(image_files, "path").select("path", "line_id", "line_ord", "text", "name", "prefix", point_list(F.col("poly")).alias("points"), "image")
    return named.groupBy("path").applyInPandas(cut, MANIFEST)


def write_summaries(lines: DataFrame, folder: str) -> None:
    """Writes the texts of each page's lines to ``<prefix>_summary.gt.txt`` below ``folder``, a line each."""
    pages = with_names(lines).groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("line_ord", "text"))).alias("ls"))

    def write(rows) -> None:
        for r in rows:
            save(f"{folder.rstrip('/')}/{r['prefix']}_summary.gt.txt", "".join(f"{x['text']}\n" for x in r["ls"]).encode())

    pages.foreachPartition(write)


def summary_lines(lines: DataFrame) -> DataFrame:
    """(prefix, line_ord, text): the lines of each page's summary file."""
    return with_names(lines).select("prefix", "line_ord", "text")


def show_pages(pieces: DataFrame, image_files: DataFrame, folder: str) -> DataFrame:
    """Writes each page's image with its regions, with its lines and with its words painted on it.

    Regions show where no line lies, lines where no word lies. Returns (path, stage, file, shapes).
    """
    colours = {"region": (200, 60, 60), "line": (60, 120, 200), "word": (60, 160, 80)}
    stages = (("region", "rgn"), ("line", "lns"), ("word", "wrd"))

    def paint(rows: pd.DataFrame) -> pd.DataFrame:
        page, out = images.read_grey(bytes(rows["image"].iloc[0])), []
        shapes = {level: [[tuple(map(int, p.split(","))) for p in t.split()] for t in rows.loc[rows["level"] == level, "points"]] for level in colours}
        picture = page
        for k, (level, tag) in enumerate(stages):
            if not shapes[level]:
                continue
            hidden = [s for deeper, _ in stages[k + 1 :] for s in shapes[deeper]]
            picture = images.painted(picture, shapes[level], colours[level], hidden)
            name = f"{folder.rstrip('/')}/{os.path.basename(rows['path'].iloc[0]).split('.')[0]}_sgm_{tag}.png"
            save(name, images.write_image(picture, "png", images.dots_per_inch(bytes(rows["image"].iloc[0]))))
            out.append((rows["path"].iloc[0], level, name, len(shapes[level])))
        return pd.DataFrame(out, columns=["path", "stage", "file", "shapes"])

    rows = pieces.filter(F.col("level").isin(list(colours)) & (F.size("poly") >= 3)).select("path", "level", point_list(F.col("poly")).alias("points"))
    return rows.join(image_files, "path").groupBy("path").applyInPandas(paint, "path string, stage string, file string, shapes int")


def polygon_data(pieces: DataFrame) -> DataFrame:
    """(path, piece_id, points, text) of pieces with three points or more; a missing text is empty."""
    return pieces.filter(F.size("poly") >= 3).select("path", "piece_id", point_list(F.col("poly")).alias("points"), F.coalesce("text", F.lit("")).alias("text"))
