"""Results as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped_number(n: Column) -> Column:
    """``1_234_567``."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("_"))


def summary_lines(results: DataFrame) -> DataFrame:
    """(eval_key, part, line) of ``summarise_cleared``: one line per key and one for the cleared result."""
    stats = F.when(F.col("n_total") > 1, F.format_string(" M:%5.2f σ:%5.2f", "median", "std")).otherwise("")
    first = F.concat("eval_key", F.format_string("\t%3d items ", "n_total"), grouped_number(F.col("n_chars")), F.format_string(" refs\t∅:%5.2f", "mean"), stats)
    c = F.col("cleared")
    number = lambda x: F.coalesce(F.format_string("%5.2f", x), F.lit("  nan"))
    second = F.concat("eval_key", F.format_string("(-%d)\t%3d items ", F.col("n_total") - c["n_total"], c["n_total"]), grouped_number(c["n_chars"]),
                      F.lit(" refs\t∅:"), number(c["mean"]), F.lit(" M:"), number(c["median"]), F.lit(" σ:"), number(c["std"]))
    lines = F.array_compact(F.array(F.struct(F.lit(0).alias("part"), first.alias("line")), F.when(c.isNotNull(), F.struct(F.lit(1).alias("part"), second.alias("line")))))
    return results.select("eval_key", F.inline(lines))


def with_difference(scores: DataFrame, key: str) -> DataFrame:
    """Adds to the second and fourth measure of a pair its difference to the one before it."""
    before = F.lag("value").over(W.partitionBy(key).orderBy("metric_idx"))
    return scores.withColumn("difference", F.when(F.col("metric_idx").isin(1, 3), F.col("value") - before))


def display_name(path: Column) -> Column:
    """File name without ending; ``+`` becomes ``:`` in a first ``_``-part that has both."""
    name = F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".xml"), F.lit(""))
    first = F.split_part(name, F.lit("_"), F.lit(1))
    swap = first.contains("+") & name.contains("_")
    return F.when(swap, F.concat(F.translate(first, "+", ":"), F.substring(name, F.length(first) + 1, F.length(name)))).otherwise(name)


def pair_lines(scores: DataFrame, key: str = "path_candidate") -> DataFrame:
    """(path_candidate, line): ``[name](type) [Cs:39.20(5308), Ls:38.54(4383)(- 0.66)]``."""
    s = with_difference(scores, key)
    refs = F.when(F.col("n_ref") > 10000, F.concat(F.format_string("%2d", F.floor(F.col("n_ref") / 1000)), F.lit("K+"))).otherwise(F.format_string("%4d", "n_ref"))
    d = F.col("difference")
    diff = F.when(d.isNull(), "").when(d > 0, F.format_string("(+%5.2f)", d)).otherwise(F.format_string("(-%5.2f)", F.abs(d)))
    one = F.concat("metric", F.format_string(":%5.2f(", "value"), refs, F.lit(")"), diff)
    rows = s.select(key, "gt_type", F.struct("metric_idx", one.alias("t")).alias("m")).groupBy(key, "gt_type").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    kind = F.when(F.col("gt_type") != "n.a.", F.concat(F.lit("("), F.substring("gt_type", 1, 3), F.lit(")"))).otherwise("")
    return rows.select(key, F.concat(F.lit("["), display_name(F.col(key)), F.lit("]"), kind, F.lit(" ["), F.array_join(F.transform("ms", lambda m: m["t"]), ", "), F.lit("]")).alias("line"))


def box_lines(lines: DataFrame, key: str, text: str, width: str, height: str) -> DataFrame:
    """(key, ord, line): one box line per character with its combining marks, then one for the line's end."""
    chars = F.regexp_extract_all(F.trim(text), F.lit(r"\P{M}\p{M}*|\p{M}+"), F.lit(0))
    rows = lines.filter(F.trim(text) != "").select(key, width, height, F.posexplode(F.concat(chars, F.array(F.lit("\t")))).alias("ord", "c"))
    return rows.select(key, "ord", F.concat("c", F.lit(" 0 0 "), F.col(width).cast("string"), F.lit(" "), F.col(height).cast("string"), F.lit(" 0")).alias("line"))


def right_to_left_lines(lines: DataFrame, key: str, text: str, width: str, height: str) -> DataFrame:
    """(key, line): the box of a whole line of right-to-left text, its characters in order of display."""
    shown = F.array_join(F.reverse(F.regexp_extract_all(F.trim(text), F.lit(r"[0-9]+|\P{M}\p{M}*|\p{M}+"), F.lit(0))), "")
    return lines.filter(F.trim(text) != "").select(key, F.concat(F.lit("WordStr 0 0 "), F.col(width).cast("string"), F.lit(" "), F.col(height).cast("string"), F.lit(" 0 #"), shown).alias("line"))
