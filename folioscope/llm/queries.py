"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import lookalikes, mixing, packing, quality, scanned


def _scans(spark: SparkSession, sf_dir: str) -> scanned.Scans:
    return scanned.Scans(table(spark, sf_dir, "alto_string"), table(spark, sf_dir, "page_line"), table(spark, sf_dir, "lexicon"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of page furniture, rows whose last word goes on in the next line, rows with a misread word."""
    return _scans(spark, sf_dir).found()


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' running text in paragraphs."""
    return _scans(spark, sf_dir).paragraphs()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text only looks like the corpus's usual characters."""
    rows = lookalikes.page_texts(table(spark, sf_dir, "alto_string"), table(spark, sf_dir, "page_line"))
    return lookalikes.lookalike_rows(rows, table(spark, sf_dir, "lexicon"))


def p4_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in one character sequence for what looks alike."""
    rows = lookalikes.page_texts(table(spark, sf_dir, "alto_string"), table(spark, sf_dir, "page_line"))
    return lookalikes.normalised_rows(rows, table(spark, sf_dir, "lexicon"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in containers of each kind."""
    return packing.pack(packing.sized_texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "container_kind"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p6_containers(spark, sf_dir), table(spark, sf_dir, "container_kind"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of sources in its order."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target")).rows()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target")).shares()


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, probability of prose and verdict of every document."""
    return quality.document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"), table(spark, sf_dir, "lexicon"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not prose."""
    return p8_quality(spark, sf_dir).filter("verdict <> 'prose'").select("doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How right the verdicts are on the hand-checked sample."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"), table(spark, sf_dir, "lexicon"))


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the packing of all texts breaks one of its rules."""
    sizes, kinds = cut(packing.sized_texts(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "container_kind")
    return packing.violations(packing.pack(sizes, kinds), sizes, kinds)


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture breaks one of its rules."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target")).violations()


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document that SQL can count as well."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    stats = quality.document_statistics(rows, table(spark, sf_dir, "lexicon"))
    return stats.select("doc_id", *[F.round(c, 6).alias(c) for c in ("digit_ratio", "mean_line_length", "repeated_lines")])


QUERIES = {f.__name__: f for f in (
    p3_found, p3_paragraphs, p4_found, p4_normalised, p6_containers, p6_fill, p6_violations, p7_mixture, p7_shares, p7_violations, p8_found, p8_quality, p8_report, p8_statistics,
)}


def _plain_sql(x: str) -> str:
    """The text as the statistics count it: long s, small e above, signs without width."""
    for a, b in ((0x17F, "'s'"), ((0x61, 0x364), "'ä'"), ((0x6F, 0x364), "'ö'"), ((0x75, 0x364), "'ü'"), *((c, "''") for c in (0x200B, 0x200D, 0x2060, 0xFEFF, 0xAD, 0x200E, 0x200F))):
        x = f"replace({x}, {' || '.join(f'chr({c})' for c in (a if isinstance(a, tuple) else (a,)))}, {b})"
    return f"lower({x})"


ORACLES = {
    "p6_violations": """SELECT container_kind, rule, 0 AS n FROM (SELECT DISTINCT container_kind FROM container_kind), (SELECT unnest(['overfull containers', 'texts with other tokens', 'texts with gaps', 'small texts divided']) AS rule)
UNION ALL SELECT container_kind, 'texts', (SELECT count(DISTINCT doc_id) FROM documents) FROM (SELECT DISTINCT container_kind FROM container_kind)""",
    "p7_violations": "SELECT unnest(['used too often', 'same copy twice', 'earlier copy missing', 'no target source']) AS rule, 0 AS n",
    "p8_statistics": f"""WITH t AS (SELECT DISTINCT doc_id, {_plain_sql("coalesce(text, '')")} AS x FROM documents),
l AS (SELECT doc_id, x, list_filter(string_split(x, chr(10)), lambda y: NOT regexp_full_match(y, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{1C}}-\\x{{1F}}]*')) AS ls FROM t)
SELECT doc_id, CASE WHEN len(ls) = 0 THEN 0.0 ELSE round((length(x) - length(translate(x, '0123456789', ''))) / greatest(1, length(translate(x, ' ' || chr(10) || chr(9), ''))), 6) END AS digit_ratio,
  CASE WHEN len(ls) = 0 THEN 0.0 ELSE round(length(x) / len(ls), 6) END AS mean_line_length, CASE WHEN len(ls) = 0 THEN 0.0 ELSE round(1 - len(list_distinct(ls)) / len(ls), 6) END AS repeated_lines FROM l""",
}
