"""Command line: ``python -m folioscope.cli eval|frame|slice|show|corpus …``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import spelling
from .operators import geometry, reports, training_pairs
from .operators.pairing import file_name, match_images
from .plans.evaluation import Evaluation
from .session import cut, ship
from .sources import layout, mets, writers


def _ratio(text: str) -> float | list[float]:
    parts = [float(p) for p in text.split(",")]
    return parts[0] if len(parts) == 1 else parts[:2]


def parser() -> argparse.ArgumentParser:
    """All commands with their options."""
    p = argparse.ArgumentParser(prog="folioscope")
    sub = p.add_subparsers(dest="command", required=True)

    e = sub.add_parser("eval", help="score candidates against references and summarise the scores")
    e.add_argument("candidates")
    e.add_argument("-r", "--reference", required=True)
    e.add_argument("-v", "--verbosity", action="count", default=0)
    e.add_argument("--metrics", default="Cs,Ls")
    e.add_argument("--utf8", default="NFC", choices=["NFC", "NFKC", "NFD", "NFKD"])
    e.add_argument("--no-outliers", action="store_true", help="do not look for outliers")
    e.add_argument("--filter-by", action="append", default=[], metavar="KEY=VALUE")
    e.add_argument("--aggregate-by", metavar="KEYS")
    e.add_argument("--mets-file")
    e.add_argument("--weighted-mean", action="store_true")
    e.add_argument("-x", "--extra", choices=["ignore_geometry"], help="ignore_geometry: all words of the candidates count")
    e.add_argument("-u", "--lt-url", help="address of a spell-check service, for the measure DictLT")
    e.add_argument("-l", "--language", default="ger", help="language of the texts for DictLT, as key of three letters")
    e.add_argument("-p", "--points", help="only words inside this polygon of the candidates count")

    f = sub.add_parser("frame", help="cut pages down to a polygon")
    f.add_argument("-i", "--input", required=True)
    f.add_argument("-o", "--output")
    f.add_argument("-p", "--points", required=True)

    s = sub.add_parser("slice", help="cut lines of images with their texts")
    s.add_argument("data")
    s.add_argument("-i", "--images", required=True, help="folder of PNG, TIFF, PGM or PPM images")
    s.add_argument("-o", "--output", default="training_data")
    s.add_argument("-m", "--minchars", type=int, default=1)
    s.add_argument("-s", "--summary", action="store_true")
    s.add_argument("-r", "--reorder", action="store_true")
    s.add_argument("--binarize", action="store_true")
    s.add_argument("--sanitize", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--intrusion-ratio", type=_ratio, default=0.1)
    s.add_argument("--rotation-threshold", type=float, default=0.1)
    s.add_argument("--padding", type=int, default=0)

    w = sub.add_parser("show", help="paint regions, lines and words on the page images")
    w.add_argument("-d", "--data", required=True)
    w.add_argument("-i", "--images", required=True)
    w.add_argument("-o", "--output", required=True)

    c = sub.add_parser("corpus", help="list full-text references of METS files by their metadata")
    c.add_argument("mets")
    c.add_argument("--filter-by", action="append", default=[], metavar="KEY=VALUE")
    return p


def _polygon(text: str | None) -> list[tuple[float, float]] | None:
    return geometry.parse_polygon(text) if text else None


def _images(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """(path, image) of pages: the image that a PAGE file names, else the one whose name fits; more than one is an error."""
    found = layout.files(spark, folder, "*.{png,tif,tiff,pgm,ppm}", recursive=False)
    own = layout.image_names(pages).filter("image_name IS NOT NULL")
    by_name = own.join(found.select(file_name(F.col("path")).alias("image_name"), F.col("path").alias("path_image")), "image_name").select("path", "path_image")
    matched = match_images(pages.select("path").join(by_name, "path", "left_anti"), found.select("path"))
    one = F.when(F.col("n_images") > 1, F.raise_error(F.concat(F.lit("several images for "), "path")).cast("string")).otherwise(F.col("path_image"))
    got = by_name.unionByName(matched.filter("n_images > 0").select("path", one.alias("path_image")))
    return got.join(found.select(F.col("path").alias("path_image"), F.col("content").alias("image")), "path_image").select("path", "image")


def run(argv: Sequence[str], spark: SparkSession) -> list[str]:
    """The lines a command prints; wrong specifications raise a ValueError before any file is read."""
    a = parser().parse_args(argv)
    ship(spark)
    if a.command == "eval":
        ev = Evaluation(spark).candidates(a.candidates).reference(a.reference).metrics(a.metrics).where(*a.filter_by).group(a.aggregate_by)
        ev.options(weighted=a.weighted_mean, strict=a.no_outliers, form=a.utf8, ignore_geometry=a.extra == "ignore_geometry")
        if a.mets_file:
            ev.mets(a.mets_file)
        if a.points:
            ev.frame(_polygon(a.points))
        if a.lt_url:
            ev.spell_checker(spelling.service(a.lt_url, a.language))
        lines = []
        if a.verbosity:
            missing = [r["path"] for r in ev.unpaired().orderBy("path").toLocalIterator()]
            lines += [f"{len(missing)} candidates have no reference"] * bool(missing) + [f"no reference: {p}" for p in missing]
            lines += [f"{r['path_candidate']}: {r['problem']}" for r in ev.problems().orderBy("path_candidate", "problem").toLocalIterator()]
        if a.mets_file:
            lines += mets.coverage_lines(ev.mets_coverage(), a.verbosity > 1)
        scores = cut(ev.scores())
        if a.verbosity > 1:
            lines += [f"{r['path']} {r['line']}" for r in ev.traces().orderBy("path", "at").toLocalIterator()]
        if a.verbosity:
            lines += [r["line"] for r in reports.pair_lines(scores).orderBy("path_candidate").toLocalIterator()]
        return lines + [r["line"] for r in reports.summary_lines(ev.run(scores)).orderBy("eval_key", "part").toLocalIterator()]
    if a.command == "frame":
        done = cut(writers.framed_files(layout.files(spark, a.input), _polygon(a.points)))
        writers.write_xml(done.filter("error IS NULL"), a.output)
        broken = [f"{r['path']}: {r['error']}" for r in done.filter("error IS NOT NULL").orderBy("path").toLocalIterator()]
        count = lambda what: done.select(F.explode(what).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n")).withColumn("change", F.lit(what))
        log = count("removed").unionByName(count("resized")).orderBy("name", "change")
        return broken + [f"{r['name']} {r['change']}: {r['n']}" for r in log.toLocalIterator()]
    if a.command == "corpus":
        return [r["href"] for r in mets.select_hrefs(mets.read_mets(layout.files(spark, a.mets, "*", recursive=False)), a.filter_by).toLocalIterator()]
    pages = layout.files(spark, a.data, recursive=False)
    pieces = cut(layout.read_pieces(pages, skip_lines=a.command == "slice").filter("error IS NULL"))
    images = cut(_images(spark, pages, a.images))
    if a.command == "show":
        return [f"{r['path']} {r['stage']}: {r['shapes']} -> {r['file']}" for r in training_pairs.show_pages(pieces, images, a.output).toLocalIterator()]
    lines = training_pairs.training_lines(pieces, a.minchars, a.reorder)
    done = training_pairs.write_pairs(lines, images, a.output, a.sanitize, a.intrusion_ratio, a.rotation_threshold, a.padding, a.binarize)
    out = [f"{r['name']}: {r['reason'] or 'written'}" for r in done.orderBy("path", "name").toLocalIterator()]
    if a.summary:
        training_pairs.write_summaries(lines, a.output)
        out += [r["text"] for r in training_pairs.summary_lines(lines).orderBy("prefix", "line_ord").toLocalIterator()]
    return out


def main() -> int:
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    try:
        print("\n".join(run(sys.argv[1:], spark)))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
