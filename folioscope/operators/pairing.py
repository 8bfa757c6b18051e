"""Which file belongs to which: candidates and references, METS entries, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_REFERENCE_ENDS = r"(?:\.gt\.xml|gt\.txt|\.xml)\z"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last ending."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*\z", "")


def pair_by_prefix(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Candidates with the first reference whose name starts with the candidate's stem.

    Both have a ``path``. First is the reference with the shortest name, then the lesser path. Equal
    prefixes meet by an equi-join: a reference name is cut only to the lengths that stems have, so no
    nested loop over both sides takes place. Candidates without a reference keep a null.
    """
    c = candidates.withColumn("_stem", file_stem(F.col("path")))
    r = references.filter(file_name(F.col("path")).rlike(_REFERENCE_ENDS)).select(F.col("path").alias("path_groundtruth"), file_name(F.col("path")).alias("_name"))
    # Every name is offered under its prefixes that end before a delimiter or at a length some stem has.
    lengths = F.broadcast(c.agg(F.sort_array(F.collect_set(F.length("_stem"))).alias("_lengths")))
    offered = r.join(lengths).select("path_groundtruth", "_name", F.explode(F.filter("_lengths", lambda n: n <= F.length("_name"))).alias("_n"))
    offered = offered.select("path_groundtruth", "_name", F.col("_name").substr(F.lit(1), F.col("_n")).alias("_stem"))
    best = F.min(F.struct(F.length("_name").alias("n"), "path_groundtruth"))
    first = offered.groupBy("_stem").agg(best.alias("_best")).select("_stem", F.col("_best.path_groundtruth").alias("path_groundtruth"))
    return c.join(first, "_stem", "left").drop("_stem")


def _parts(text: Column, lengths: Column) -> Column:
    """All parts of a text that have one of the lengths."""
    fit = F.filter(lengths, lambda n: (n > 0) & (n <= F.length(text)))
    return F.array_distinct(F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: text.substr(at, n)))))


def _lengths(df: DataFrame, text: Column) -> DataFrame:
    """One row: the lengths that occur, of which there are no more than a name or path is long."""
    return F.broadcast(df.agg(F.sort_array(F.collect_set(F.length(text))).alias("_ls")))


def href_matches(entries: DataFrame, hrefs: DataFrame, path: str = "path_groundtruth") -> DataFrame:
    """(entry's columns, href, ord …): all hrefs that contain the entry's file name or are contained in its path.

    Both directions are equi-joins: hrefs are offered under the parts of their path segments that have
    the length of a file name, paths under their parts that have the length of an href. If both
    sides have a column ``mets`` only hrefs of the entry's own METS file meet it.
    """
    own = ["mets"] if "mets" in entries.columns and "mets" in hrefs.columns else []
    e = entries.withColumn("_file", file_name(F.col(path)))
    h = hrefs.filter("href IS NOT NULL AND href <> ''")
    segments = h.join(_lengths(e, F.col("_file"))).withColumn("_s", F.explode(F.array_distinct(F.split("href", "/"))))
    offered = segments.withColumn("_file", F.explode(_parts(F.col("_s"), F.col("_ls")))).drop("_s", "_ls").distinct()
    holds = e.join(offered, [*own, "_file"]).drop("_file")
    parts = e.drop("_file").join(_lengths(h, F.col("href"))).withColumn("href", F.explode(_parts(F.col(path), F.col("_ls")))).drop("_ls")
    within = parts.join(h, [*own, "href"])
    return holds.unionByName(within).distinct()


def match_hrefs(entries: DataFrame, hrefs: DataFrame, path: str = "path_groundtruth") -> DataFrame:
    """Entries with the first METS file reference, of either kind, in document order (by ``mets``, if ``hrefs``
    has it, then ``ord``) that ``href_matches``; its columns are null without one."""
    new = [c for c in ("mets", "ord", "href") if c in hrefs.columns and c not in entries.columns]
    keys = [c for c in ("mets", path) if c in entries.columns]
    best = href_matches(entries.select(*keys).distinct(), hrefs, path).groupBy(*keys).agg(F.min(F.struct(*new)).alias("_m"))
    return entries.join(best, keys, "left").select(*entries.columns, *[F.col(f"_m.{c}").alias(c) for c in sorted(new, key="href ord mets".split().index)])


def match_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages (``path``) with the one image whose stem (text before the first dot) their name contains.

    ``n_images`` tells how many matched: 0 has to be reported, more than 1 is an error. Images are
    offered under their stem and pages under their stem and its parts, which meet by equality.
    """
    stem = lambda c: F.regexp_extract(file_name(F.col(c)), r"\A[^.]*", 0)
    i = images.filter(file_name(F.col("path")).rlike(r"(?i)\.(?:jpe?g|tiff?|png|p[gp]m)\z")).select(F.col("path").alias("path_image"), stem("path").alias("_stem"))
    p = pages.withColumn("_name", file_name(F.col("path"))).join(_lengths(i, F.col("_stem")))
    hit = p.select("path", F.explode(_parts(F.col("_name"), F.col("_ls"))).alias("_stem")).join(i, "_stem")
    found = hit.groupBy("path").agg(F.count("*").alias("n_images"), F.min("path_image").alias("path_image"))
    return pages.join(found, "path", "left").fillna(0, ["n_images"])


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def by_precedence(files: DataFrame, linked: DataFrame, key: list[str]) -> DataFrame:
    """Files with their DMDIDs: the last structural link wins, else the file's own, else its group's.

    ``files`` has ``file_dmdid`` and ``grp_dmdid``, ``linked`` (key, ord, link_dmdid).
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    last = linked.filter(F.trim("link_dmdid") != "").groupBy(*key).agg(F.max(F.struct("ord", "link_dmdid")).alias("_l"))
    out = files.join(last, key, "left").withColumn("dmdid", F.coalesce(F.col("_l.link_dmdid"), blank("file_dmdid"), blank("grp_dmdid")))
    return out.drop("_l")
