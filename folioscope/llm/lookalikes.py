"""One character sequence for texts that look the same.

Every word or mark of the texts is a value. Values are mapped (zero-width signs away, variants of
width and look-alike letters to one) and grouped in SQL under the accent-sensitive collation
``UNICODE``, which also holds composed and combining accents equal. Each class gets one canonical
member: one of the lexicon, else one in plain characters, else the more frequent, else the lesser in
binary order. Of zero-width signs alone the canonical member is the empty text. The members are joined
back to the rows.

Classes are kept per script of the page, so that a one-letter word that exists in two scripts is
judged by its page. All counts are pre-aggregated; only values that differ from their canonical
member meet the rows again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..session import cut
from .characters import folded, plain_form
from .vocabulary import meet

#: A word with its accents and joiners, or one mark or blank beyond ASCII.
VALUE = r"[\p{L}\p{M}\p{N}\p{Cf}]+|[^\p{L}\p{M}\p{N}\p{Cf}\x{20}-\x{7E}]"
#: The same, and what lies between.
PIECE = VALUE + r"|[\x{20}-\x{7E}&&[^\p{L}\p{N}]]+"

# Script of each lexicon language.
SCRIPTS = {"ger": "Latn", "eng": "Latn", "fre": "Latn", "rus": "Cyrl", "ara": "Arab", "per": "Pers"}


def page_texts(alto_string: DataFrame, page_line: DataFrame) -> DataFrame:
    """Rows (tbl, row_id, mets_id, page_no, text) of both page tables; a row that stands again counts once."""
    a = alto_string.select(F.lit("alto_string").alias("tbl"), F.col("string_rid").alias("row_id"), "mets_id", "page_no", F.col("content").alias("text"))
    p = page_line.select(F.lit("page_line").alias("tbl"), F.col("line_rid").alias("row_id"), "mets_id", "page_no", F.col("text_equiv").alias("text"))
    rows = a.unionByName(p).filter(F.col("text").isNotNull() & (F.col("text") != "") & F.col("row_id").isNotNull())
    return rows.dropDuplicates(["tbl", "mets_id", "page_no", "row_id", "text"])


def with_script(rows: DataFrame) -> DataFrame:
    """Adds ``script``, the one with most letters on the row's page (``Pers`` is Arabic script with
    more letters that only Persian uses than such that only Arabic uses; ``none`` without letters).

    A row whose work or page is null is judged by itself.
    """
    beyond = F.col("text").rlike(r"[^\x00-\x7F]")
    letters = lambda pattern: F.length(F.regexp_replace("text", f"[^{pattern}]+", ""))
    other = lambda pattern: F.when(beyond, letters(pattern)).otherwise(0)
    counts = rows.withColumns({
        "_l": F.when(beyond, letters("A-Za-zÀ-ɏ")).otherwise(letters("A-Za-z")), "_c": other("Ѐ-ӿ"), "_a": other("؀-ۿ"), "_p": other("پچژگکی"), "_q": other("يكىةأإ"),
        "_own": F.when(F.col("mets_id").isNull() | F.col("page_no").isNull(), F.col("row_id")),
    })
    page = W.partitionBy("tbl", "mets_id", "page_no", "_own")
    counts = counts.withColumns({c: F.sum(c).over(page) for c in ("_l", "_c", "_a", "_p", "_q")})
    most = F.greatest("_l", "_c", "_a")
    script = (
        F.when(most == 0, "none").when(F.col("_l") == most, "Latn").when(F.col("_c") == most, "Cyrl")
        .when(F.col("_p") > F.col("_q"), "Pers").otherwise("Arab")
    )
    return counts.withColumn("script", script).drop("_l", "_c", "_a", "_p", "_q", "_own")


@F.pandas_udf(T.StringType())
def _plain(value: pd.Series, script: pd.Series) -> pd.Series:
    return pd.Series([plain_form(v, s) for v, s in zip(value, script, strict=True)])


def canonical_values(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(script, value, canonical) of every value of the rows (with ``script``, see ``with_script``)."""
    spark = rows.sparkSession
    values = (
        rows.select("script", F.explode(F.regexp_extract_all("text", F.lit(VALUE), F.lit(0))).alias("value"))
        .groupBy("script", "value").agg(F.count("*").alias("n"))
    )
    members = values.withColumn("plain", _plain("value", "script"))
    members = cut(members.withColumn("mapped", folded(F.col("plain"))))
    plain = members.select("script", F.col("plain").alias("value"), F.lit(0).cast("bigint").alias("n"), "plain", "mapped")
    everyone = cut(members.unionByName(plain.filter("plain <> ''")).groupBy("script", "value", "plain", "mapped").agg(F.sum("n").alias("n")))
    scripts = F.create_map(*[F.lit(x) for kv in SCRIPTS.items() for x in kv])
    known = lexicon.select(scripts[F.col("lang")].alias("script"), F.lower("word").alias("lower_word")).filter("script is not null").distinct()
    names = {n: f"folio_{n}_{id(rows)}" for n in ("members", "known")}
    everyone.createOrReplaceTempView(names["members"])
    known.createOrReplaceTempView(names["known"])
    out = spark.sql(f"""
        WITH member AS (
            SELECT m.script, m.value, m.plain, m.mapped COLLATE UNICODE AS looks, m.n, k.lower_word IS NOT NULL AND m.value = m.plain AS in_lexicon, m.value = m.plain AS is_plain
            FROM {names["members"]} m LEFT JOIN {names["known"]} k ON m.script = k.script AND lower(m.value) = k.lower_word),
        class AS (
            SELECT script, looks, min_by(value, struct(NOT in_lexicon, NOT is_plain, -n, value)) AS chosen
            FROM member GROUP BY script, looks)
        SELECT member.script, member.value, CASE WHEN member.plain = '' THEN '' WHEN member.in_lexicon THEN member.value ELSE class.chosen END AS canonical
        FROM member JOIN class ON member.script = class.script AND member.looks = class.looks""")
    for n in names.values():
        spark.catalog.dropTempView(n)
    return out


def deviating_values(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(tbl, row_id, script, value, canonical) for each value of a row (with ``script``) that is not its
    class's canonical member. A frequent value is met apart from the others (``vocabulary.meet``)."""
    odd = canonical_values(rows, lexicon).filter("value <> canonical")
    key = F.concat_ws("\u0001", "script", "value")
    # Plain ASCII on a Latin page is canonical by construction, so such values need not meet the classes.
    ascii_ = F.col("text").rlike(r"\A[\x{20}-\x{7E}]*\z") & (F.col("script") == "Latn")
    seen = rows.filter(~ascii_).select("tbl", "row_id", "script", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(VALUE), F.lit(0)))).alias("value"))
    seen = seen.filter(~((F.col("script") == "Latn") & F.col("value").rlike(r"\A[\x{20}-\x{7E}]*\z")))
    return meet(seen, key, cut(odd.select(key.alias("key"), "canonical")), "key", "inner")


def lookalike_rows(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(tbl, row_id) of rows with at least one value that only looks like its canonical member.

    Null, empty and blank texts have no values. Ties between members go to the lesser in binary
    order. Works on empty tables.
    """
    return deviating_values(cut(with_script(rows)), lexicon).select("tbl", "row_id").distinct()


def normalised_rows(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The rows (tbl, row_id, text) with every deviating value replaced by its canonical member."""
    rows = cut(with_script(rows))  # read for the classes, to meet them, and for the result
    odd = deviating_values(rows, lexicon).groupBy("tbl", "row_id").agg(
        F.map_from_entries(F.collect_set(F.struct("value", "canonical"))).alias("new")
    )
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    better = F.array_join(F.transform(pieces, lambda t: F.coalesce(F.try_element_at("new", t), t)), "")
    return rows.join(odd, ["tbl", "row_id"], "left").select("tbl", "row_id", F.when(F.col("new").isNotNull(), better).otherwise(F.col("text")).alias("text"))
