"""Queries of the evaluation operators over the driver's tables, and their SQL.

Each instance runs over whole tables and whole texts. Where a candidate text is needed it is the
reference with some letters misread (``e`` as ``c``, ``o`` as ``0``), left out or doubled, and with words
run together and parted.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, similarity
from .functions import text as tx
from .operators import filters, geometry, grouping, images, pairing, reports, statistics
from .plans.evaluation import score
from .queries_data import _P5_BLOCKS
from .session import table
from .sources import layout, mets, writers

# Stop words of the query instances.
STOP = ["und", "der", "die", "das", "the", "and", "of", "was", "de", "la", "le"]
_FRAME = [(100.0, 200.0), (900.0, 200.0), (900.0, 1500.0), (100.0, 1500.0)]
_R6 = lambda c: F.round(c, 6)


# What the candidates have for the reference's letters, in this order, after the single letters.
_SLIPS = (("rn", "m"), ("ss", "s"), ("ll", "lll"), ("nd ", "nd"), ("ch", "c h"), (", ", " "))


def _slips(x: Column) -> Column:
    x = F.translate(x, "eo", "c0")
    for a, b in _SLIPS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _sql_slips(x: str) -> str:
    x = f"translate({x}, 'eo', 'c0')"
    for a, b in _SLIPS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_line").filter("text_equiv IS NOT NULL").select("line_rid", "mets_id", "page_no", F.col("text_equiv").alias("ref")).distinct()
    return rows.withColumn("cand", _slips(F.col("ref")))


_LINES = f"line AS (SELECT DISTINCT line_rid, mets_id, page_no, text_equiv AS ref, {_sql_slips('text_equiv')} AS cand FROM page_line WHERE text_equiv IS NOT NULL)"


def _sql_chars(chars: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in chars)


_WS, _PU, _DI = (_sql_chars(x) for x in (tx.WHITESPACE, tx.PUNCTUATION, tx.DIGITS))
_PU_ONLY = _sql_chars("".join(c for c in tx.PUNCTUATION if c not in tx.WHITESPACE))
_BREAK = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOK = lambda c: f"list_filter(regexp_split_to_array({c}, '{_BREAK}'), lambda t: t <> '')"
_SIM = lambda r, c: f"CASE WHEN greatest(length({r}), length({c})) = 0 THEN 100.0 ELSE 100.0 * (1 - levenshtein({r}, {c}) / greatest(length({r}), length({c}))) END"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {_LINES} SELECT line_rid, round({_SIM('ref', 'cand')}, 6) AS value, length(ref) AS n_ref FROM line")
def cs_similarity(spark, sf_dir):
    """Character similarity of every line."""
    r, c = tx.normalized_whitespace(F.col("ref")), tx.normalized_whitespace(F.col("cand"))
    return _lines(spark, sf_dir).select("line_rid", _R6(similarity.character_similarity(r, c)).alias("value"), F.length(r).alias("n_ref"))


@query(f"""WITH {_LINES}, l AS (SELECT line_rid, translate(ref, {_WS}||{_PU}||{_DI}, '') AS r, translate(cand, {_WS}||{_PU}||{_DI}, '') AS c FROM line)
SELECT line_rid, round({_SIM("r", "c")}, 6) AS value, length(r) AS n_ref FROM l""")
def letters_similarity(spark, sf_dir):
    """Letter similarity of every line."""
    return _lines(spark, sf_dir).select("line_rid", _R6(similarity.letter_similarity(F.col("ref"), F.col("cand"))).alias("value"), F.length(tx.letters(F.col("ref"))).alias("n_ref"))


@query(f"""WITH {_LINES}, t AS (SELECT line_rid, {_TOK("ref")} AS r, {_TOK("cand")} AS c FROM line),
d AS (SELECT line_rid, r, c, list_distinct(list_concat(r, c)) AS d FROM t),
e AS (SELECT line_rid, len(r) AS n_ref, greatest(len(r), len(c)) AS most,
  list_aggregate(list_transform(r, lambda x: chr(CAST(33 + list_position(d, x) AS INTEGER))), 'string_agg', '') AS a,
  list_aggregate(list_transform(c, lambda x: chr(CAST(33 + list_position(d, x) AS INTEGER))), 'string_agg', '') AS b FROM d)
SELECT line_rid, round(CASE WHEN most = 0 THEN 100.0 ELSE 100.0 * (1 - levenshtein(coalesce(a, ''), coalesce(b, '')) / most) END, 6) AS value, n_ref FROM e""")
def word_similarity(spark, sf_dir):
    """Edit similarity of every line's token sequence."""
    return _lines(spark, sf_dir).select("line_rid", _R6(similarity.word_similarity(F.col("ref"), F.col("cand"))).alias("value"), F.size(tx.tokens(F.col("ref"))).alias("n_ref"))


@query(f"""WITH {_LINES}, t AS (SELECT line_rid, {_TOK("ref")} AS r, {_TOK("cand")} AS c FROM line),
x AS (SELECT line_rid, unnest(r) AS token, 1 AS s FROM t UNION ALL SELECT line_rid, unnest(c), -1 FROM t),
o AS (SELECT line_rid, sum(odd) AS odd FROM (SELECT line_rid, token, abs(sum(s)) AS odd FROM x GROUP BY ALL) GROUP BY 1)
SELECT t.line_rid, round(CASE WHEN len(r) + len(c) = 0 THEN 100.0 ELSE 100.0 * (1 - coalesce(odd, 0) / (len(r) + len(c))) END, 6) AS value, len(r) AS n_ref
FROM t LEFT JOIN o USING (line_rid)""")
def bow_similarity(spark, sf_dir):
    """Bag-of-words similarity of every line."""
    return similarity.bag_similarity(_lines(spark, sf_dir), "line_rid", "ref", "cand").withColumn("value", _R6(F.col("value")))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query(f"""WITH {_LINES}, t AS (SELECT line_rid, list_distinct(list_filter({_TOK("ref")}, lambda x: NOT list_contains({_STOP_SQL}, x))) AS r,
  list_distinct(list_filter({_TOK("cand")}, lambda x: NOT list_contains({_STOP_SQL}, x))) AS c FROM line),
m AS (SELECT line_rid, CASE WHEN len(c) = 0 THEN 0.0 ELSE 100.0 * len(list_intersect(r, c)) / len(c) END AS p,
  CASE WHEN len(r) > 0 THEN 100.0 * len(list_intersect(r, c)) / len(r) END AS q FROM t)
SELECT line_rid, round(p, 6) AS pre, round(q, 6) AS rec, round(coalesce(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) END, 0.0), 6) AS f FROM m""")
def ir_measures(spark, sf_dir):
    """Precision, recall and their harmonic mean of every line's terms."""
    p, q = similarity.precision(F.col("ref"), F.col("cand"), STOP), similarity.recall(F.col("ref"), F.col("cand"), STOP)
    return _lines(spark, sf_dir).select("line_rid", _R6(p).alias("pre"), _R6(q).alias("rec"), _R6(similarity.f_measure(p, q)).alias("f"))


def _summary_sql(source: str, keys: str, weighted: bool, chars: bool = False) -> str:
    mean = "CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) ELSE avg(v) END" if weighted else "avg(v)"
    return f"""s AS ({source}),
t AS (SELECT {keys}, count(v) AS n_total, {mean} AS mean, stddev_pop(v) AS std, median(v) AS med, sum(w) AS n_chars FROM s GROUP BY {keys}),
q AS (SELECT {keys}, median(CASE WHEN v < med THEN v END) AS q1, median(CASE WHEN v > med THEN v END) AS q3 FROM s JOIN t USING ({keys}) GROUP BY {keys}),
k AS (SELECT {keys}, count(v) AS n2, {mean} AS mean2, stddev_pop(v) AS std2, median(v) AS med2, sum(w) AS chars2 FROM s JOIN q USING ({keys})
  WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY {keys}),
r AS (SELECT t.*, std >= 1 AND n_total > 1 AND coalesce(n2, 0) < n_total AS has, coalesce(n2, 0) AS n2, mean2, std2, med2, chars2 FROM t LEFT JOIN k USING ({keys}))
SELECT {keys}, n_total, round(mean, 6) AS mean, round(std, 6) AS std, round(med, 6) AS median, n_chars,
  CASE WHEN has THEN n2 END AS cleared_n, round(CASE WHEN has THEN {"coalesce(mean2, 0.0)" if weighted else "mean2"} END, 6) AS cleared_mean,
  round(CASE WHEN has THEN std2 END, 6) AS cleared_std, round(CASE WHEN has THEN med2 END, 6) AS cleared_median{", CASE WHEN has THEN coalesce(chars2, 0) END AS cleared_chars" if chars else ""} FROM r"""


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    c = F.col("cleared")
    return df.select(*keys, "n_total", _R6(F.col("mean")).alias("mean"), _R6(F.col("std")).alias("std"), _R6(F.col("median")).alias("median"), "n_chars",
                     c["n_total"].alias("cleared_n"), _R6(c["mean"]).alias("cleared_mean"), _R6(c["std"]).alias("cleared_std"), _R6(c["median"]).alias("cleared_median"))


@query(f"""WITH {_LINES}, e AS (SELECT mets_id, round({_SIM('ref', 'cand')}, 9) AS v, length(ref) AS w FROM line),
{_summary_sql("SELECT 'Cs@metadata_mets:' || mets_id AS eval_key, v, w FROM e", "eval_key", True)}""")
def evaluation_summary(spark, sf_dir):
    """Flagship: character similarity of all lines, summarised per work by weighted mean, with and without outliers."""
    pairs = _lines(spark, sf_dir).select(F.create_map(F.lit("mets"), F.col("mets_id").cast("string")).alias("tags"), F.col("ref").alias("text_reference"), F.col("cand").alias("text_candidate"))
    r, c = tx.normalized_whitespace(F.col("text_reference")), tx.normalized_whitespace(F.col("text_candidate"))
    scores = pairs.select("tags", F.lit("Cs").alias("metric"), F.round(similarity.character_similarity(r, c), 9).alias("value"), F.length(r).cast("bigint").alias("n_ref"))
    keyed = grouping.explode_keys(scores, grouping.Grouping.parse("metadata:mets"))
    return _flat(statistics.summarise_cleared(keyed, ["eval_key"], weighted=True), "eval_key")


_FLAT_SQL = r"nfc_normalize(regexp_replace({0}, '\r\n|[\r\n\x0b\x0c]', ' ', 'g'))"


def _measures_sql() -> str:
    """Every measure of every line by SQL: (metric, mets_id, line_rid, v, w), values with two decimals."""
    tr = f"{_WS}||{_PU}||{_DI}"
    # DuckDB counts bytes: every character of a pair becomes one of ASCII.
    chars = lambda x, of: f"coalesce(list_aggregate(list_transform(regexp_extract_all({x}, '(?s).'), lambda z: chr(CAST(33 + list_position({of}, z) AS INTEGER))), 'string_agg', ''), '')"
    both = "list_distinct(list_concat(regexp_extract_all(r, '(?s).'), regexp_extract_all(c, '(?s).')))"
    terms = lambda c: f"list_distinct(list_filter({c}, lambda x: NOT list_contains({_STOP_SQL}, x)))"
    return f"""p AS (SELECT mets_id, line_rid, {_FLAT_SQL.format("ref")} AS r, {_FLAT_SQL.format("cand")} AS c FROM line),
tk AS (SELECT mets_id, line_rid, r, c, translate(r, {tr}, '') AS lr, translate(c, {tr}, '') AS lc, {_TOK("r")} AS tr, {_TOK("c")} AS tc FROM p),
u AS (SELECT *, {terms("tr")} AS ur, {terms("tc")} AS uc, list_distinct(list_concat(tr, tc)) AS d, {both} AS k FROM tk),
e AS (SELECT *, {chars("r", "k")} AS r1, {chars("c", "k")} AS c1, {chars("lr", "k")} AS r2, {chars("lc", "k")} AS c2, greatest(len(tr), len(tc)) AS most, list_aggregate(list_transform(tr, lambda x: chr(CAST(33 + list_position(d, x) AS INTEGER))), 'string_agg', '') AS a,
  list_aggregate(list_transform(tc, lambda x: chr(CAST(33 + list_position(d, x) AS INTEGER))), 'string_agg', '') AS b,
  CASE WHEN len(uc) = 0 THEN 0.0 ELSE 100.0 * len(list_intersect(ur, uc)) / len(uc) END AS pre, CASE WHEN len(ur) > 0 THEN 100.0 * len(list_intersect(ur, uc)) / len(ur) END AS rec FROM u),
x AS (SELECT line_rid, unnest(tr) AS token, 1 AS s FROM tk UNION ALL SELECT line_rid, unnest(tc), -1 FROM tk),
o AS (SELECT line_rid, sum(odd) AS odd FROM (SELECT line_rid, token, abs(sum(s)) AS odd FROM x GROUP BY ALL) GROUP BY 1),
m AS (SELECT 'Cs' AS metric, mets_id, line_rid, {_SIM("r1", "c1")} AS v, length(r) AS w FROM e UNION ALL SELECT 'Ls', mets_id, line_rid, {_SIM("r2", "c2")}, length(lr) FROM e
  UNION ALL SELECT 'Ws', mets_id, line_rid, CASE WHEN most = 0 THEN 100.0 ELSE 100.0 * (1 - levenshtein(coalesce(a, ''), coalesce(b, '')) / most) END, len(tr) FROM e
  UNION ALL SELECT 'BoWs', mets_id, e.line_rid, CASE WHEN len(tr) + len(tc) = 0 THEN 100.0 ELSE 100.0 * (1 - coalesce(odd, 0) / (len(tr) + len(tc))) END, len(tr) FROM e LEFT JOIN o USING (line_rid)
  UNION ALL SELECT 'IRPre', mets_id, line_rid, pre, len(ur) FROM e UNION ALL SELECT 'IRRec', mets_id, line_rid, rec, len(ur) FROM e
  UNION ALL SELECT 'IRF', mets_id, line_rid, coalesce(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) END, 0.0), len(ur) FROM e)"""


def _scores(spark, sf_dir):
    pairs = _lines(spark, sf_dir).select("mets_id", "line_rid", F.col("ref").alias("text_reference"), F.col("cand").alias("text_candidate"))
    return score(pairs, ["Cs", "Ls", "Ws", "BoWs", "IRPre", "IRRec", "IRF"], STOP)


@query(f"""WITH {_LINES}, {_measures_sql()},
{_summary_sql("SELECT metric, mets_id, CAST(round_even(v, 2) AS DOUBLE) AS v, w FROM m WHERE v IS NOT NULL", "metric, mets_id", False)}""")
def evaluation_measures(spark, sf_dir):
    """All measures of every line in long form, summarised per measure and work."""
    return _flat(statistics.summarise_cleared(_scores(spark, sf_dir), ["metric", "mets_id"]), "metric", "mets_id")


_ITEMS = "SELECT l_returnflag, l_linestatus, l_extendedprice / 1000 AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 1000).alias("value"), F.col("l_quantity").cast("bigint").alias("n_ref"))


@query(f"WITH {_summary_sql(_ITEMS, 'l_returnflag, l_linestatus', True)}")
def tukey_weighted(spark, sf_dir):
    """Weighted summaries with the result cleared of outliers."""
    return _flat(statistics.summarise_cleared(_items(spark, sf_dir), ["l_returnflag", "l_linestatus"], weighted=True), "l_returnflag", "l_linestatus")


@query("WITH " + _summary_sql("SELECT o_orderpriority, o_totalprice * o_totalprice / 1e9 AS v, 1 AS w FROM orders", "o_orderpriority", False))
def tukey_plain(spark, sf_dir):
    """Unweighted summaries of skewed values with the result cleared of outliers."""
    s = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") * F.col("o_totalprice") / 1e9).alias("value"), F.lit(1).cast("bigint").alias("n_ref"))
    return _flat(statistics.summarise_cleared(s, ["o_orderpriority"]), "o_orderpriority")


@query("""SELECT o_orderpriority, round(CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) ELSE avg(v) END, 6) AS mean FROM
(SELECT o_orderpriority, o_totalprice AS v, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_custkey END AS w FROM orders) GROUP BY 1""")
def weighted_mean_zero_fallback(spark, sf_dir):
    """A key whose weights add up to nothing takes the plain mean."""
    s = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("value"), F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(F.col("o_custkey")).alias("n_ref"))
    return s.groupBy("o_orderpriority").agg(_R6(statistics.weighted_mean()).alias("mean"))


@query("SELECT doc_id, length(nfc_normalize(text)) AS n FROM documents")
def nfc_text_lengths(spark, sf_dir):
    """Length of every document in the composed normal form."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(tx.normalized_encoding(F.col("text"))).alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\r\n|[\r\n\x0b\x0c]', ' ', 'g')) AS digest FROM documents")
def whitespace_normalized(spark, sf_dir):
    """Digest of every document with line breaks as blanks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalized_whitespace(F.col("text"))).alias("digest"))


@query(f"""SELECT doc_id, length(text) - length(translate(text, {_WS}, '')) AS whitespace, length(text) - length(translate(text, {_PU_ONLY}, '')) AS punctuation,
length(text) - length(translate(text, {_DI}, '')) AS digits FROM documents""")
def char_class_removals(spark, sf_dir):
    """Characters of each class in every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(tx.class_removals(F.col("text")))))


@query(r"""SELECT doc_id, md5(list_aggregate(list_transform(string_split(regexp_replace(text, '\n\z', ''), chr(10)), lambda s: regexp_replace(regexp_replace(s,
'\A[\t-\r\x{1C}-\x{20}\x{85}\x{A0}]+', ''), '[\t-\r\x{1C}-\x{20}\x{85}\x{A0}]+\z', '')), 'string_agg', ' ')) AS digest FROM documents""")
def line_fallback_text(spark, sf_dir):
    """Digest of every document with its stripped lines joined by blanks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.one_line(F.col("text"))).alias("digest"))


@query(f"WITH t AS (SELECT doc_id, {_TOK('text')} AS t FROM documents) SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS unique_tokens, len(list_distinct(list_filter(t, lambda x: NOT list_contains({_STOP_SQL}, x)))) AS terms FROM t")
def token_counts(spark, sf_dir):
    """Tokens, distinct tokens and terms of every document."""
    t = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("tokens"), F.size(tx.token_set(F.col("text"))).alias("unique_tokens"), F.size(tx.without(t, STOP)).alias("terms"))


@query(f"""WITH {_LINES} SELECT line_rid, coalesce(list_aggregate(list_filter(regexp_split_to_array(translate(ref, {_sql_chars(tx.NOT_IN_WORDS)}, ''), '{_BREAK}'),
lambda t: length(t) > 1), 'string_agg', ' '), '') AS words FROM line""")
def dictionary_lines(spark, sf_dir):
    """Every line as a dictionary compares it."""
    return _lines(spark, sf_dir).select("line_rid", tx.dictionary_line(F.col("ref")).alias("words"))


def _vowels_sql(x: str) -> str:
    for letters, umlaut in (("aAàáâãäåÀÁÂÃÄÅ", "ä"), ("oOòóôõöÒÓÔÕÖ", "ö"), ("uUùúûüÙÚÛÜ", "ü")):
        x = f"regexp_replace({x}, '[{letters}]' || chr(868), '{umlaut}', 'g')"
    return x


@query(f"""WITH {_LINES}, v AS (SELECT line_rid, {_vowels_sql("ref")} AS words FROM line)
SELECT line_rid, contains(words, chr(868)) AS misplaced, CASE WHEN NOT contains(words, chr(868)) THEN words END AS words FROM v""")
def vowels_composed(spark, sf_dir):
    """Every line with a small e above a vowel as umlaut; where it stands elsewhere the line has no text but says so."""
    v = tx.vowels_checked(F.col("ref"))
    return _lines(spark, sf_dir).select("line_rid", v["misplaced"].alias("misplaced"), v["text"].alias("words"))


@query("""WITH y AS (SELECT doc_id, try_cast(substr(trim(date_issued), 1, 4) AS INTEGER) AS y FROM documents WHERE regexp_full_match(substr(trim(date_issued), 1, 4), '[0-9]{1,4}'))
SELECT d.doc_id, CAST(floor(y / 10) * 10 AS INTEGER) || 's' AS decade,
CAST(floor((y - 1) / 100) + 1 AS INTEGER) || CASE WHEN (floor((y - 1) / 100) + 1) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN (floor((y - 1) / 100) + 1) % 10 = 1 THEN 'st'
WHEN (floor((y - 1) / 100) + 1) % 10 = 2 THEN 'nd' WHEN (floor((y - 1) / 100) + 1) % 10 = 3 THEN 'rd' ELSE 'th' END AS century FROM documents d LEFT JOIN y USING (doc_id)""")
def century_decade_buckets(spark, sf_dir):
    """Decade and century of every document's date."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", dates.decade(F.col("date_issued")).alias("decade"), dates.century(F.col("date_issued")).alias("century"))


def _entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tags = F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), lambda k, v: v.isNotNull())
    return d.select("doc_id", F.lit("Cs").alias("metric"), F.coalesce("gt_type", F.lit("n.a.")).alias("gt_type"), tags.alias("tags"), (F.col("n_chars") % 101).cast("double").alias("value"), F.col("n_chars").alias("n_ref"))


_KEYED = """e AS (SELECT n_chars % 101 AS v, n_chars AS w, lang, source, CASE WHEN gt_type <> 'n.a.' THEN gt_type END AS kind FROM documents)"""


def _keys(df):
    return df.groupBy("eval_key").agg(F.count("*").alias("n"), _R6(F.avg("value")).alias("mean"), F.sum("n_ref").alias("n_chars"))


@query(f"""WITH {_KEYED} SELECT eval_key, count(*) AS n, round(avg(v), 6) AS mean, sum(w) AS n_chars FROM (
SELECT 'Cs@metadata_lang:' || lang AS eval_key, v, w FROM e WHERE lang IS NOT NULL UNION ALL SELECT 'Cs@metadata_source:' || source, v, w FROM e WHERE source IS NOT NULL
UNION ALL SELECT 'Cs@type:' || kind, v, w FROM e WHERE kind IS NOT NULL) GROUP BY 1""")
def multi_dim_flat(spark, sf_dir):
    """One key per dimension."""
    return _keys(grouping.explode_keys(_entries(spark, sf_dir), grouping.Grouping.parse("metadata:lang, metadata:source, type")))


@query(f"""WITH {_KEYED} SELECT eval_key, count(*) AS n, round(avg(v), 6) AS mean, sum(w) AS n_chars FROM (
SELECT 'Cs@metadata_lang:' || lang AS eval_key, v, w FROM e WHERE lang IS NOT NULL UNION ALL SELECT 'Cs@metadata_source:' || source, v, w FROM e WHERE source IS NOT NULL
UNION ALL SELECT 'Cs@metadata_lang:' || lang || '/metadata_source:' || source, v, w FROM e WHERE lang IS NOT NULL AND source IS NOT NULL) GROUP BY 1""")
def multi_dim_hier(spark, sf_dir):
    """The composite key beside one key per dimension."""
    return _keys(grouping.explode_keys(_entries(spark, sf_dir), grouping.Grouping.parse("metadata:lang+metadata:source")))


@query("""SELECT 'metadata_lang' AS dimension, count(lang) AS with_value, count(*) - count(lang) AS omitted FROM documents
UNION ALL SELECT 'type', count(CASE WHEN gt_type <> 'n.a.' THEN 1 END), count(*) - count(CASE WHEN gt_type <> 'n.a.' THEN 1 END) FROM documents""")
def dimension_coverage(spark, sf_dir):
    """Entries with and without a value per dimension."""
    return grouping.coverage(_entries(spark, sf_dir), grouping.Grouping.parse("metadata:lang,type"))


def _paths(spark, sf_dir):
    f = table(spark, sf_dir, "mets_file").select("mets_id", "file_id", "grp_use", "href").distinct()
    path = F.concat_ws("/", F.lit(""), F.lit("data"), F.lit("corpus"), F.col("mets_id"), F.coalesce("grp_use", F.lit("none")), F.col("href"))
    return f.select("mets_id", "file_id", path.alias("path_candidate"), F.lit("corpus").alias("root"), F.lit("Cs").alias("metric"), F.col("href").alias("path_groundtruth"))


@query("""WITH f AS (SELECT DISTINCT mets_id, file_id, grp_use, href FROM mets_file)
SELECT eval_key, count(*) AS n FROM (SELECT 'Cs@corpus' AS eval_key FROM f UNION ALL SELECT 'Cs@' || mets_id FROM f UNION ALL SELECT 'Cs@' || coalesce(grp_use, 'none') FROM f) GROUP BY 1""")
def directory_explode(spark, sf_dir):
    """A key for every directory above a file up to the root."""
    e = grouping.with_entry_columns(_paths(spark, sf_dir))
    return grouping.explode_directories(e).groupBy("eval_key").agg(F.count("*").alias("n"))


@query(r"""SELECT DISTINCT mets_id, file_id, href, CASE WHEN t LIKE 'art%' THEN 'article' WHEN t LIKE 'ann%' THEN 'announcement' ELSE 'n.a.' END AS gt_type,
CASE WHEN regexp_matches(href, '_(\d+)_(\d+)') THEN regexp_extract(href, '_(\d+)_(\d+)', 2) END AS page FROM (
SELECT *, coalesce(nullif(regexp_extract(href, 'gt.(\w{3,}).xml$', 1), ''), nullif(regexp_extract(href, '\.(\w{3,})\.gt\.xml$', 1), '')) AS t FROM mets_file)""")
def names_of_files(spark, sf_dir):
    """Type and page number from file names; null without a match."""
    e = _paths(spark, sf_dir).select("mets_id", "file_id", F.col("path_groundtruth").alias("href"), F.col("path_groundtruth").alias("path_candidate"))
    return e.select("mets_id", "file_id", "href", grouping.type_of_name(F.col("href")).alias("gt_type"), grouping.pattern_dimension(r"_(\d+)_(\d+)", 2).column.alias("page"))


def _dmds(spark, sf_dir):
    return table(spark, sf_dir, "mets_dmd").select("mets_id", "dmdid", "received_at", "mods").distinct()


def _mods(spark, sf_dir):
    m = _dmds(spark, sf_dir).select("mets_id", "dmdid", "received_at", F.inline("mods"))
    return mets.joined_values(m.withColumnRenamed("mods_value", "value"), "mets_id", "dmdid", "received_at", "dimension")


def _languages(spark, sf_dir):
    values = _mods(spark, sf_dir).filter("dimension = 'language'").select("mets_id", "dmdid", "received_at", F.col("value").alias("language"))
    return _dmds(spark, sf_dir).drop("mods").join(values, ["mets_id", "dmdid", "received_at"], "left")


_LANG = """lang AS (SELECT mets_id, dmdid, received_at, nullif(list_aggregate(list_transform(list_sort(list_transform(list_filter(mods, lambda x: x.dimension = 'language' AND x.mods_value IS NOT NULL),
lambda x: {'o': x.ord, 'v': x.mods_value})), lambda x: x.v), 'string_agg', '+'), '') AS language FROM (SELECT DISTINCT mets_id, dmdid, received_at, mods FROM mets_dmd))"""


@query("""WITH d AS (SELECT DISTINCT mets_id, dmdid, received_at, mods FROM mets_dmd), x AS (SELECT mets_id, dmdid, received_at, unnest(mods) AS m FROM d)
SELECT mets_id, dmdid, received_at, m.dimension AS dimension, string_agg(m.mods_value, '+' ORDER BY m.ord, m.mods_value) AS value FROM x WHERE m.mods_value <> '' GROUP BY ALL""")
def mods_multi_value(spark, sf_dir):
    """The values of every dimension of every dmdSec joined in document order."""
    return _mods(spark, sf_dir)


@query(f"""WITH {_LANG}, o AS (SELECT *, list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(language, ''), '[+|,]'), lambda x: trim(x)), lambda x: x <> '')) AS have FROM lang)
SELECT mets_id, dmdid, received_at, coalesce(trim(language) = 'ger', false) AS is_ger, list_has_all(have, ['eng', 'ger']) AS has_both FROM o""")
def filter_exact_and_superset(spark, sf_dir):
    """Equality with one label, containment of several."""
    t = _languages(spark, sf_dir)
    hit = lambda e: F.coalesce(filters.value_matches(F.col("language"), F.lit(e)), F.lit(False))
    return t.select("mets_id", "dmdid", "received_at", hit("ger").alias("is_ger"), hit("ger+eng").alias("has_both"))


@query(f"""WITH {_LANG} SELECT count(*) AS before, count(CASE WHEN trim(language) = 'ger' THEN 1 END) AS kept, count(CASE WHEN trim(language) <> 'ger' AND trim(language) <> '' THEN 1 END) AS different,
count(CASE WHEN language IS NULL OR trim(language) = '' THEN 1 END) AS missing, round(100.0 * (count(*) - count(CASE WHEN trim(language) = 'ger' THEN 1 END)) / count(*), 6) AS percent_left_out FROM lang""")
def filter_missing_report(spark, sf_dir):
    """What a filter keeps, what differs and what has no value."""
    e = _languages(spark, sf_dir).withColumn("tags", F.create_map(F.lit("language"), F.col("language")))
    return filters.filter_report(e, filters.Filter.parse("metadata:language=ger")).withColumn("percent_left_out", _R6(F.col("percent_left_out")))


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "mets_file").filter("href IS NOT NULL").select(F.concat(F.lit("c/"), F.regexp_extract("href", r"\A[^.]*", 0), F.lit(".xml")).alias("path")).distinct()


@query(r"""WITH c AS (SELECT DISTINCT 'c/' || regexp_extract(href, '^[^.]*') || '.xml' AS path, regexp_extract(href, '^[^.]*') AS stem FROM mets_file WHERE href IS NOT NULL),
r AS (SELECT DISTINCT href FROM mets_file WHERE regexp_matches(href, '(\.gt\.xml|gt\.txt|\.xml)$')),
m AS (SELECT path, href, row_number() OVER (PARTITION BY path ORDER BY length(href), href) AS n FROM c JOIN r ON starts_with(r.href, c.stem))
SELECT c.path, m.href AS path_groundtruth FROM c LEFT JOIN m ON c.path = m.path AND m.n = 1""")
def prefix_first_match(spark, sf_dir):
    """Candidates with the first reference whose name starts with their stem."""
    refs = table(spark, sf_dir, "mets_file").filter("href IS NOT NULL").select(F.col("href").alias("path")).distinct()
    return pairing.pair_by_prefix(_candidates(spark, sf_dir), refs)


@query(r"""WITH f AS (SELECT DISTINCT mets_id, href, ord FROM mets_file WHERE mets_id IS NOT NULL AND href <> ''),
e AS (SELECT DISTINCT mets_id AS mets, unnest(['gt/' || mets_id || '/' || href, 'gt/' || mets_id || '/' || substr(href, 3), 'gt/x' || href || '/page', 'gt/' || mets_id || '/none.xml']) AS path_groundtruth FROM f),
m AS (SELECT mets, path_groundtruth, href, ord, row_number() OVER (PARTITION BY mets, path_groundtruth ORDER BY ord, href) AS n FROM e JOIN f ON f.mets_id = e.mets
  AND (contains(href, regexp_extract(path_groundtruth, '[^/]*$')) OR contains(path_groundtruth, href)))
SELECT e.mets, e.path_groundtruth, m.href, m.ord FROM e LEFT JOIN m ON e.mets = m.mets AND e.path_groundtruth = m.path_groundtruth AND m.n = 1""")
def href_match(spark, sf_dir):
    """Entries with the first METS file reference that holds their name, in whole or in part, or that their path holds."""
    f = table(spark, sf_dir, "mets_file").filter("mets_id IS NOT NULL AND href <> ''").select(F.col("mets_id").alias("mets"), "href", "ord").distinct()
    at = lambda *parts: F.concat(*[F.lit(x) if x.endswith("/") or x.startswith("/") or x == "gt/x" else F.col(x).cast("string") for x in parts])
    named = F.array(at("gt/", "mets", "/", "href"), F.concat(at("gt/", "mets", "/"), F.substring("href", 3, 10_000)), at("gt/x", "href", "/page"), at("gt/", "mets", "/none.xml"))
    e = f.select("mets", F.explode(named).alias("path_groundtruth")).distinct()
    return pairing.match_hrefs(e, f)


@query(r"""WITH f AS (SELECT DISTINCT mets_id AS mets, href FROM mets_file WHERE contains(upper(grp_use), 'FULLTEXT') AND href <> ''),
e AS (SELECT DISTINCT 'gt/' || regexp_extract(href, '[^/]*$') AS path FROM mets_file WHERE href <> ''),
m AS (SELECT DISTINCT path, mets, href FROM e JOIN f ON contains(f.href, regexp_extract(e.path, '[^/]*$')) OR contains(e.path, f.href))
SELECT 'mapped' AS kind, count(DISTINCT path) AS n FROM m UNION ALL SELECT 'missing', count(*) FROM e WHERE path NOT IN (SELECT path FROM m)
UNION ALL SELECT 'represented', count(*) FROM (SELECT DISTINCT mets, href FROM m) UNION ALL SELECT 'unused', count(*) FROM f WHERE (mets, href) NOT IN (SELECT (mets, href) FROM m)""")
def mets_coverage(spark, sf_dir):
    """How files of all groups and full-text references meet, counted."""
    f = table(spark, sf_dir, "mets_file").filter("href <> ''").withColumnRenamed("mets_id", "mets")
    e = f.select(F.concat(F.lit("gt/"), pairing.file_name(F.col("href"))).alias("path_groundtruth")).distinct()
    report = mets.coverage(e, mets.Mets(f, None, None, None, None)).groupBy("kind").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([(k,) for k in ("mapped", "missing", "represented", "unused")], "kind string")
    return kinds.join(report, "kind", "left").fillna(0)


@query("""WITH l AS (SELECT DISTINCT doc_id FROM doc_label) SELECT 'labelled' AS side, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM l)
UNION ALL SELECT 'without', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT 'unknown', count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def coverage_semi_anti(spark, sf_dir):
    """Documents with and without a label, labels without a document."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "doc_label").select("doc_id").distinct()
    n = lambda side, df: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n("labelled", d.join(lab, "doc_id", "left_semi")).unionByName(n("without", filters.without_partner(d, lab, ["doc_id"]))).unionByName(n("unknown", filters.without_partner(lab, d, ["doc_id"])))


@query("""WITH f AS (SELECT mets_id, file_id, min(ord) AS ord, arg_min(file_dmdid, (ord, coalesce(file_dmdid, ''))) AS a FROM mets_file GROUP BY ALL),
file AS (SELECT DISTINCT mets_id, file_id, file_dmdid, grp_dmdid FROM mets_file),
link AS (SELECT p.mets_id, p.file_id, max({'ord': d.ord, 'link_dmdid': d.dmdid}) AS l FROM (SELECT DISTINCT mets_id, div_id, file_id FROM mets_fptr) p
  JOIN (SELECT DISTINCT mets_id, div_id, ord, dmdid FROM mets_div WHERE trim(dmdid) <> '') d ON p.mets_id = d.mets_id AND p.div_id = d.div_id GROUP BY ALL)
SELECT file.mets_id, file.file_id, file_dmdid, grp_dmdid, coalesce(l.link_dmdid, nullif(trim(file_dmdid), ''), nullif(trim(grp_dmdid), '')) AS dmdid
FROM file LEFT JOIN link ON file.mets_id = link.mets_id AND file.file_id = link.file_id""")
def precedence_join(spark, sf_dir):
    """DMDIDs of files: the last structural link, else the file's own, else the group's."""
    f = table(spark, sf_dir, "mets_file").select("mets_id", "file_id", "file_dmdid", "grp_dmdid").distinct()
    p = table(spark, sf_dir, "mets_fptr").select("mets_id", "div_id", "file_id").distinct()
    d = table(spark, sf_dir, "mets_div").select("mets_id", "div_id", "ord", F.col("dmdid").alias("link_dmdid")).distinct()
    return pairing.by_precedence(f, p.join(d, ["mets_id", "div_id"]), ["mets_id", "file_id"])


@query("SELECT DISTINCT mets_id, file_id, href FROM mets_file WHERE contains(upper(grp_use), 'FULLTEXT')")
def fulltext_refs(spark, sf_dir):
    """Files of groups that hold full texts."""
    from .sources.mets import fulltext_refs as op

    return op(table(spark, sf_dir, "mets_file")).select("mets_id", "file_id", "href").distinct()


def _words(spark, sf_dir):
    w = table(spark, sf_dir, "alto_string").select("string_rid", "mets_id", "page_no", "line_ord", "string_ord", "content", "hpos", "vpos", "width", "height").distinct()
    corner = geometry.box_polygon(F.col("hpos"), F.col("vpos"), F.col("hpos") + F.col("width"), F.col("vpos") + F.col("height"))
    return w.withColumn("poly", corner)


_WORDS = "word AS (SELECT DISTINCT string_rid, mets_id, page_no, line_ord, string_ord, content, hpos, vpos, width, height FROM alto_string)"


@query(f"WITH {_WORDS} SELECT mets_id, page_no, line_ord, min(hpos) AS minx, min(vpos) AS miny, max(hpos + width) AS maxx, max(vpos + height) AS maxy FROM word GROUP BY ALL")
def bbox_by_line(spark, sf_dir):
    """The box of every line's words."""
    return geometry.boxes_of(_words(spark, sf_dir), "mets_id", "page_no", "line_ord")


@query(f"""WITH {_WORDS} SELECT string_rid FROM word WHERE hpos + width / 2.0 > 100 AND hpos + width / 2.0 < 900 AND vpos + height / 2.0 > 200 AND vpos + height / 2.0 < 1500""")
def words_in_frame(spark, sf_dir):
    """Words whose centre lies inside a frame."""
    w = _words(spark, sf_dir).filter("hpos IS NOT NULL AND vpos IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    return w.filter(geometry.in_frame(geometry.centroid(F.col("poly")), _FRAME)).select("string_rid")


@query(f"""WITH {_WORDS}, kept AS (SELECT * FROM word WHERE hpos + width / 2.0 > 100 AND hpos + width / 2.0 < 900 AND vpos + height / 2.0 > 200 AND vpos + height / 2.0 < 1500)
SELECT 'line' AS level, mets_id || '/' || page_no || '/' || line_ord AS piece_id, min(hpos) || ',' || min(vpos) || ' ' || max(hpos + width) || ',' || max(vpos + height) AS box FROM kept GROUP BY mets_id, page_no, line_ord
UNION ALL SELECT 'region', mets_id || '/' || page_no, min(hpos) || ',' || min(vpos) || ' ' || max(hpos + width) || ',' || max(vpos + height) FROM kept GROUP BY mets_id, page_no""")
def frame_filter_rollup(spark, sf_dir):
    """Lines and pages shrunk to their words inside a frame; those without words are gone."""
    w = _words(spark, sf_dir).filter("hpos IS NOT NULL AND vpos IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    page, line = F.concat_ws("/", F.col("mets_id").cast("string"), F.col("page_no").cast("string")), F.concat_ws("/", F.col("mets_id").cast("string"), F.col("page_no").cast("string"), F.col("line_ord").cast("string"))
    word = w.select(F.lit("all").alias("path"), F.lit("word").alias("level"), F.col("string_rid").cast("string").alias("piece_id"), page.alias("region_id"), line.alias("line_id"), "poly")
    above = lambda level, c: word.groupBy("path", F.col(c).alias("piece_id"), F.lit(level).alias("level")).agg(F.max("region_id").alias("region_id"), F.max("line_id").alias("line_id"), F.first("poly").alias("poly"))
    pieces = word.unionByName(above("line", "line_id")).unionByName(above("region", "region_id"))
    b = geometry.box(F.col("poly"))
    text = lambda c: b[c].cast("bigint").cast("string")
    out = geometry.cut_to_frame(pieces, _FRAME).filter("level <> 'word'")
    return out.select("level", "piece_id", F.concat(text("minx"), F.lit(","), text("miny"), F.lit(" "), text("maxx"), F.lit(","), text("maxy")).alias("box"))


@query(r"""WITH p AS (SELECT DISTINCT line_rid, regexp_split_to_array(trim(points), '\s+') AS p FROM page_line WHERE regexp_full_match(points, '\s*[0-9]+,[0-9]+(\s+[0-9]+,[0-9]+){2,}\s*')),
x AS (SELECT line_rid, list_transform(p, lambda t: CAST(split_part(t, ',', 1) AS DOUBLE)) AS x, list_transform(p, lambda t: CAST(split_part(t, ',', 2) AS DOUBLE)) AS y FROM p)
SELECT line_rid, list_min(x) AS minx, list_min(y) AS miny, list_max(x) AS maxx, list_max(y) AS maxy, round(list_avg(x), 6) AS cx, round(list_avg(y), 6) AS cy FROM x""")
def polygons_of_lines(spark, sf_dir):
    """Box and vertex mean of every line's polygon."""
    p = table(spark, sf_dir, "page_line").select("line_rid", "points").distinct().withColumn("poly", geometry.polygon(F.col("points"))).filter("size(poly) > 2")
    m, b = geometry.vertex_mean(F.col("poly")), geometry.box(F.col("poly"))
    return p.select("line_rid", *[b[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")], _R6(m["x"]).alias("cx"), _R6(m["y"]).alias("cy"))


_POINTS_SQL = r"""p AS (SELECT DISTINCT line_rid, regexp_split_to_array(trim(points), '\s+') AS p FROM page_line WHERE regexp_full_match(points, '\s*-?\d+(\.\d+)?,-?\d+(\.\d+)?(\s+-?\d+(\.\d+)?,-?\d+(\.\d+)?)+\s*')),
n AS (SELECT line_rid, len(p) AS n, unnest(range(len(p))) AS i, p FROM p),
v AS (SELECT line_rid, i, n, CAST(split_part(p[i + 1], ',', 1) AS DOUBLE) AS x, CAST(split_part(p[i + 1], ',', 2) AS DOUBLE) AS y,
  CAST(split_part(p[(i + 1) % n + 1], ',', 1) AS DOUBLE) AS nx, CAST(split_part(p[(i + 1) % n + 1], ',', 2) AS DOUBLE) AS ny FROM n),
a AS (SELECT line_rid, sum(x * ny - nx * y) AS a2, sum((x + nx) * (x * ny - nx * y)) AS sx, sum((y + ny) * (x * ny - nx * y)) AS sy, avg(x) AS ax, avg(y) AS ay FROM v GROUP BY 1)"""


@query(f"WITH {_POINTS_SQL} SELECT line_rid, round(CASE WHEN a2 = 0 THEN ax ELSE sx / (3 * a2) END, 4) AS cx, round(CASE WHEN a2 = 0 THEN ay ELSE sy / (3 * a2) END, 4) AS cy FROM a")
def polygon_centroids(spark, sf_dir):
    """Area centroid of every line's polygon."""
    p = table(spark, sf_dir, "page_line").select("line_rid", "points").distinct().withColumn("poly", geometry.polygon(F.col("points"))).filter("poly IS NOT NULL")
    c = geometry.centroid(F.col("poly"))
    return p.select("line_rid", F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"))


@query(f"WITH {_WORDS} SELECT mets_id, page_no, line_ord, string_agg(content, ' ' ORDER BY string_ord, string_rid) AS text FROM word WHERE content IS NOT NULL GROUP BY ALL")
def ordered_text_rollup(spark, sf_dir):
    """Text of every line in the order of its words."""
    w = _words(spark, sf_dir).filter("content IS NOT NULL")
    pieces = w.select(F.concat_ws("/", "mets_id", "page_no").alias("path"), F.lit("word").alias("level"), F.lit(0).alias("region_ord"), "line_ord", F.col("string_ord").alias("word_ord"), F.col("content").alias("text"))
    lines = layout.line_texts(pieces)
    at = F.split("path", "/")
    return lines.select(at[0].cast("bigint").alias("mets_id"), at[1].cast("int").alias("page_no"), "line_ord", "text")


def alto_text_blocks(space: Column) -> Column:
    """(path, b) of all TextBlocks of a print space: its own, those of its ComposedBlocks and of the ComposedBlocks inside these."""

    def own(e: Column, above: Column) -> Column:
        return F.coalesce(F.transform(e["text_blocks"], lambda b, i: F.struct(F.concat(above, F.lit("tb:"), i.cast("string")).alias("path"), b.alias("b"))), F.array())

    def composed(e: Column, above: Column, of) -> Column:
        return F.coalesce(F.flatten(F.transform(e["composed_blocks"], lambda c, i: of(c, F.concat(above, F.lit("cb:"), i.cast("string"), F.lit("/"))))), F.array())

    return F.concat(own(space, F.lit("")), composed(space, F.lit(""), lambda c, at: F.concat(own(c, at), composed(c, at, own))))


def _alto_document(block: pd.Series) -> pd.Series:
    """Each block as an ALTO file of its own; its lines are named by their place."""

    def one(b) -> bytes:
        root = ET.Element("alto", xmlns="http://www.loc.gov/standards/alto/ns-v3#")
        page = ET.SubElement(ET.SubElement(root, "Layout"), "Page", ID="p", WIDTH="1", HEIGHT="1")
        tb = ET.SubElement(ET.SubElement(page, "PrintSpace"), "TextBlock", ID="tb")
        lines = json.loads(b).get("text_lines") or []
        for j, line in enumerate(lines):
            tl = ET.SubElement(tb, "TextLine", ID=f"tl:{j}")
            for e in (line or {}).get("elems") or []:
                ET.SubElement(tl, e["tag"], **({"CONTENT": e["content"]} if e.get("content") is not None else {}))
        return ET.tostring(root)

    return block.map(one)


@query(_P5_BLOCKS.split(",\nst AS")[0] + """,
el AS (SELECT page_id, path, i, e.elems[i].tag AS tag, e.elems[i].content AS content, sum(CASE WHEN e.elems[i].tag = 'SP' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, path ORDER BY i) AS island,
  sum(CASE WHEN e.elems[i].tag = 'SP' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, path) AS sps FROM tl, range(1, 100000) r(i) WHERE i <= len(e.elems)),
w AS (SELECT page_id, path, CASE WHEN sps > 0 THEN island ELSE i END AS island, string_agg(content, '' ORDER BY i) AS word FROM el WHERE tag = 'String' AND trim(content) <> '' GROUP BY ALL)
SELECT page_id, path, string_agg(word, ' ' ORDER BY island) AS text FROM w GROUP BY ALL""")
def sp_gap_island(spark, sf_dir):
    """Words of all nested ALTO lines, at any depth of ComposedBlocks, as the ALTO reader finds them: Strings between blanks are one word."""
    p = table(spark, sf_dir, "alto_page").select("page_id", "print_space").distinct()
    b = p.select("page_id", F.inline(alto_text_blocks(F.col("print_space")))).filter("size(b.text_lines) > 0")
    document = F.pandas_udf(_alto_document, "binary")(F.to_json("b"))
    files = b.select(F.concat_ws("/", F.col("page_id"), "path").alias("path"), document.alias("content"))
    lines = layout.line_texts(layout.read_pieces(files).filter("error IS NULL")).filter("text <> ''")
    names = layout.read_pieces(files).filter("level = 'line'").select("path", "region_ord", "line_ord", F.col("piece_id").alias("line"))
    at = lines.join(names, ["path", "region_ord", "line_ord"])
    return at.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("bigint").alias("page_id"), F.concat(F.regexp_replace("path", r"\A[^/]*/", ""), F.lit("/"), "line").alias("path"), "text")


@query("""SELECT mets_id, page_no, first(text_equiv ORDER BY coalesce(equiv_index, ''), line_rid) AS text FROM (SELECT DISTINCT line_rid, mets_id, page_no, equiv_index, text_equiv FROM page_line
WHERE trim(text_equiv) <> '') GROUP BY ALL""")
def first_by_index(spark, sf_dir):
    """The text with the least index, compared as a string; a missing index is the empty string."""
    p = table(spark, sf_dir, "page_line").filter("trim(text_equiv) <> ''").select("line_rid", "mets_id", "page_no", "equiv_index", "text_equiv").distinct()
    return pairing.first_of(p, ["mets_id", "page_no"], [F.coalesce("equiv_index", F.lit("")), F.col("line_rid")]).select("mets_id", "page_no", F.col("text_equiv").alias("text"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber - 1 AS metric_idx, l_extendedprice AS value, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b
FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL))
SELECT l_orderkey, metric_idx, round(CASE WHEN metric_idx IN (1, 3) THEN value - b END, 6) AS difference FROM d""")
def pair_metric_delta(spark, sf_dir):
    """Difference of the second and fourth measure to the one before."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("metric_idx")).agg(F.max("l_extendedprice").alias("value"))
    return reports.with_difference(s, "l_orderkey").select("l_orderkey", "metric_idx", _R6(F.col("difference")).alias("difference"))


def _report_sql() -> str:
    """The summaries as lines of text, with a second line for the cleared one."""
    grouped = lambda x: f"replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', '_')"
    number = lambda x: f"coalesce(printf('%5.2f', {x}), '  nan')"
    source = f"SELECT 'Cs@' || l_returnflag || '/' || l_linestatus AS eval_key, v, w FROM ({_ITEMS})"
    return f"""WITH x AS (SELECT * FROM (WITH {_summary_sql(source, "eval_key", False, chars=True)}))
SELECT eval_key, 0 AS part, eval_key || chr(9) || printf('%3d items ', n_total) || {grouped("n_chars")} || ' refs' || chr(9) || '∅:' || printf('%5.2f', mean)
  || CASE WHEN n_total > 1 THEN ' M:' || printf('%5.2f', median) || ' σ:' || printf('%5.2f', std) ELSE '' END AS line FROM x
UNION ALL SELECT eval_key, 1, eval_key || printf('(-%d)', n_total - cleared_n) || chr(9) || printf('%3d items ', cleared_n) || {grouped("cleared_chars")} || ' refs' || chr(9) || '∅:'
  || {number("cleared_mean")} || ' M:' || {number("cleared_median")} || ' σ:' || {number("cleared_std")} FROM x WHERE cleared_n IS NOT NULL"""


@query(_report_sql())
def report_lines(spark, sf_dir):
    """Summaries as lines of text."""
    s = _items(spark, sf_dir).withColumn("eval_key", F.concat(F.lit("Cs@"), "l_returnflag", F.lit("/"), "l_linestatus"))
    return reports.summary_lines(statistics.summarise_cleared(s, ["eval_key"]))


_GREY = "g AS (SELECT vec_id, CAST(greatest(0, least(255, round(127.5 + 127.5 * e))) AS INTEGER) AS v FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings))"


def _kernel(spark, sf_dir, kernel, kind: str) -> DataFrame:
    """(vec_id, value): a kernel over each vector, taken for a row of grey pixels."""

    def run(vectors: pd.Series) -> pd.Series:
        pixels = [np.clip(np.floor(127.5 + 127.5 * np.asarray(v, dtype=np.float64) + 0.5), 0, 255).astype(np.uint8).reshape(1, -1) for v in vectors]
        return pd.Series([kernel(p) for p in pixels])

    return table(spark, sf_dir, "embeddings").select("vec_id", F.pandas_udf(run, kind)("embedding").alias("value"))


@query(f"WITH {_GREY} SELECT vec_id, median(v) AS reference FROM g WHERE v > 127 GROUP BY 1")
def grey_reference(spark, sf_dir):
    """Median of the bright pixels by the image kernel."""
    return _kernel(spark, sf_dir, images.grey_reference, "double").filter(~F.isnan("value")).select("vec_id", F.col("value").alias("reference"))


@query(f"""WITH {_GREY}, p AS (SELECT vec_id, v, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT vec_id, v, sum(n) OVER k AS w, sum(n * v) OVER k AS s, sum(n) OVER (PARTITION BY vec_id) AS t, sum(n * v) OVER (PARTITION BY vec_id) AS st FROM p WINDOW k AS (PARTITION BY vec_id ORDER BY v)),
b AS (SELECT vec_id, v, pow(CAST(st AS DOUBLE) * w / t - s, 2) / (CAST(w AS DOUBLE) * (t - w)) AS between_classes FROM c WHERE w < t)
SELECT vec_id, round(max(between_classes), 3) AS best FROM b GROUP BY 1""")
def otsu_histogram(spark, sf_dir):
    """How well the threshold of the image kernel parts each vector's pixels: as well as the best one does."""

    def parted(p: np.ndarray) -> float:
        low = p[p <= images.otsu_threshold(p)].astype(float)
        w, t, total = len(low), p.size, float(p.sum())
        return (total * w / t - low.sum()) ** 2 / (w * (t - w)) if 0 < w < t else float("nan")

    return _kernel(spark, sf_dir, parted, "double").filter(~F.isnan("value")).select("vec_id", F.round("value", 3).alias("best"))


def _page_pieces(spark, sf_dir) -> DataFrame:
    """The words of all scanned pages as pieces of ALTO files without blanks (each String is a word)."""
    w = _words(spark, sf_dir).filter("hpos IS NOT NULL AND vpos IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL AND trim(content) <> ''")
    path = F.concat_ws("/", F.col("mets_id"), F.col("page_no"))
    rows = w.select(path.alias("path"), F.lit("word").alias("level"), F.col("string_rid").cast("string").alias("piece_id"), F.lit("b").alias("region_id"), F.concat(F.lit("l"), "line_ord").alias("line_id"),
                    F.lit(0).alias("region_ord"), "line_ord", F.col("string_ord").alias("word_ord"), F.regexp_replace("content", r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "").alias("text"), "poly")
    above = lambda level, name, *by: rows.groupBy("path", *by).agg(F.first("poly").alias("poly"), F.lit(level).alias("level"), F.max(name).alias("piece_id"))
    pieces = rows.unionByName(above("line", "line_id", "region_id", "line_id", "region_ord", "line_ord"), True).unionByName(above("region", "region_id", "region_id", "region_ord"), True)
    return pieces.unionByName(rows.groupBy("path").agg(F.lit("page").alias("level"), F.lit("p").alias("piece_id"), F.first("poly").alias("poly")), True).withColumns(
        {"format": F.lit("alto"), "error": F.lit(None).cast("string")})


_BOXED = f"""{_WORDS}, w AS (SELECT mets_id || '/' || page_no AS path, line_ord, string_ord, string_rid, content, hpos AS x, vpos AS y, width AS w, height AS h FROM word
  WHERE hpos IS NOT NULL AND vpos IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL AND trim(content) <> ''),
gt AS (SELECT path, min(x) AS minx, min(y) AS miny, max(x + w) AS maxx, max(y + h) AS maxy FROM w WHERE NOT regexp_matches(content, '^[0-9]') GROUP BY 1)"""


@query(f"WITH {_BOXED} SELECT * FROM gt")
def gt_boxes(spark, sf_dir):
    """The printed area of every scanned page, read from its XML: the box of the words that do not start with a digit."""
    xml = writers.to_xml(_page_pieces(spark, sf_dir)).select("path", F.encode("xml", "UTF-8").alias("content"))
    b = F.col("box")
    return layout.bounding_boxes(xml).filter("box IS NOT NULL").select("path", *[b[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query(f"""WITH {_BOXED}, k AS (SELECT w.path, string_agg(content, ' ' ORDER BY line_ord, string_ord, string_rid) AS text, count(*) AS n FROM w JOIN gt USING (path)
  WHERE x + w / 2.0 > minx + 200 AND x + w / 2.0 < maxx - 200 AND y + h / 2.0 > miny AND y + h / 2.0 < maxy GROUP BY 1)
SELECT path, n AS words, length(text) AS characters FROM k""")
def framed_scores(spark, sf_dir):
    """Words and characters of every scanned page inside its printed area without 200 pixels on either side."""
    pieces = _page_pieces(spark, sf_dir)
    words = pieces.filter("level = 'word'")
    area = geometry.boxes_of(words.filter(~F.col("text").rlike(r"\A[0-9]")), "path")
    area = area.select("path", F.struct((F.col("minx") + 200).alias("minx"), "miny", (F.col("maxx") - 200).alias("maxx"), "maxy").alias("box"))
    inside = geometry.words_in_boxes(words.join(area.select("path"), "path", "left_semi"), area)
    lines = layout.line_texts(inside).groupBy("path").agg(F.sum(F.length("text")).alias("c"), F.count("*").alias("n_lines"))
    n = inside.groupBy("path").agg(F.count("*").alias("words"))
    return n.join(lines, "path").select("path", "words", (F.col("c") + F.col("n_lines") - 1).alias("characters"))
