"""Queries of the general data problems (rejected lines, orphan references, nested pages) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.nested import alto_table
from .operators.orphans import mets_references, mets_targets, orphan_references
from .operators.raw_rows import broken_rows, loaded_rows, read_feeds
from .session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that break their feed's format."""
    raw = table(spark, sf_dir, "raw_record").select("raw_id", "feed_id", "raw_line")
    return broken_rows(raw, read_feeds(table(spark, sf_dir, "raw_feed"))).select("raw_id")


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines per feed, reason and first broken field."""
    raw = table(spark, sf_dir, "raw_record").select("raw_id", "feed_id", "raw_line")
    broken = broken_rows(raw, read_feeds(table(spark, sf_dir, "raw_feed")))
    return broken.groupBy("feed_id", "reject_reason", "reject_field").agg(F.count("*").alias("lines"))


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines of all feeds as typed rows; of points their number and the sums of their coordinates."""
    raw = table(spark, sf_dir, "raw_record").select("raw_id", "feed_id", "raw_line")
    rows = loaded_rows(raw, read_feeds(table(spark, sf_dir, "raw_feed")))
    total = lambda c: F.aggregate("points", F.lit(0).cast("bigint"), lambda a, p: a + p[c])
    return rows.withColumns({"n_points": F.size("points"), "sum_x": total("x"), "sum_y": total("y")}).drop("points").withColumn("n_points", F.when(F.col("n_points") >= 0, F.col("n_points")))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, f"mets_{n}") for n in ("file", "div", "fptr", "dmd")}
    return orphan_references(mets_references(t["file"], t["div"], t["fptr"]), mets_targets(t["dmd"], t["file"]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose target did not live when the referring row was recorded."""
    return _orphans(spark, sf_dir).select("ref_table", "ref_field", "ref_month", F.col("scope").alias("mets_id"), "row_key", "target_id").distinct()


def p2_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field and month."""
    return p2_found(spark, sf_dir).groupBy("ref_table", "ref_field", "ref_month").agg(F.count("*").alias("orphans"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of a page with its parent."""
    return alto_table(table(spark, sf_dir, "alto_page")).select("page_id", "parent_path", F.col("path").alias("child_path"))


def _elements(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    return alto_table(table(spark, sf_dir, "alto_page"), code).drop("kind").withColumnRenamed("path", "child_path")


def p5_composed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the pages' ComposedBlocks."""
    return _elements(spark, sf_dir, "cb")


def p5_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the pages' TextBlocks."""
    return _elements(spark, sf_dir, "tb")


def p5_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the pages' TextLines."""
    return _elements(spark, sf_dir, "tl")


def p5_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the pairs of points of all elements."""
    return _elements(spark, sf_dir, "pt")


def p5_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the pages' Strings."""
    return alto_table(table(spark, sf_dir, "alto_page"), "st").drop("kind", "tag").withColumnRenamed("path", "child_path")


def _sql_field(name: str, sep: str, quote: str) -> str:
    """RE2 pattern of one field, written for the oracle only."""
    bad = r"\x00-\x08\x0b-\x1f\x7f-\x{9f}\x{fffd}"
    s = {"\t": r"\t", "|": r"\|"}.get(sep, sep)
    value = {
        "hpos": "[0-9]+", "vpos": "[0-9]+", "width": "0*[1-9][0-9]*", "height": "0*[1-9][0-9]*",
        "points": " *[0-9]+,[0-9]+(?: +[0-9]+,[0-9]+){2,} *", "wc": r"(?:0(?:\.[0-9]+)?|1(?:\.0+)?|)",
        "conf": r"(?:0(?:\.[0-9]+)?|1(?:\.0+)?|)", "region_type": "(?:TextRegion|TableCell)",
    }.get(name, r"[A-Za-z_][A-Za-z0-9_.\-]*" if name.endswith("_id") else None)
    if value is None:
        return f"(?:{quote}(?:[^{quote}{bad}]|{quote}{quote})*{quote}|[^{s}{quote}\\n{bad}]*)"
    bare = "" if name == "points" and sep == "," else f"|{value}"
    return f"(?:{quote}{value}{quote}{bare})"


# The feeds' layouts, written for the oracle only.
_SQL_FEEDS = {
    1: (",", '"', "string_id line_id content hpos vpos width height wc"),
    2: (";", '"', "line_id region_id points text_equiv conf"),
    3: ("\t", '"', "string_id content points wc"),
    4: ("|", "'", "region_id region_type points text_equiv"),
    5: (",", '"', "word_id line_id points content conf"),
}


def _sql_pattern(n: int) -> str:
    """Pattern of a whole line of a feed with a group per field."""
    sep, quote, names = _SQL_FEEDS[n]
    s = {"\t": r"\t", "|": r"\|"}.get(sep, sep)
    return s.join(f"({_sql_field(f, sep, quote)})" for f in names.split()).replace("'", "''")


def _p1_rows_sql() -> str:
    """Typed columns of the valid lines of every feed."""
    columns = list(dict.fromkeys(f for _, _, names in _SQL_FEEDS.values() for f in names.split() if f != "points"))
    parts = []
    for n, (_, quote, names) in _SQL_FEEDS.items():
        q, fields = quote.replace("'", "''"), names.split()

        def value(f: str, fields=fields, q=q, n=n) -> str:
            raw = f"regexp_extract(line, '{_sql_pattern(n)}', {fields.index(f) + 1}, 's')"
            return f"CASE WHEN starts_with({raw}, '{q}') THEN replace(substr({raw}, 2, length({raw}) - 2), '{q}{q}', '{q}') ELSE {raw} END"

        kind = {"hpos": "BIGINT", "vpos": "BIGINT", "width": "BIGINT", "height": "BIGINT", "wc": "DOUBLE", "conf": "DOUBLE"}
        cols = [(f"try_cast({value(c)} AS {kind[c]})" if c in kind else value(c)) if c in fields else f"CAST(NULL AS {kind.get(c, 'VARCHAR')})" for c in columns]
        pts = f"regexp_split_to_array(trim({value('points')}, ' '), ' +')" if "points" in fields else "CAST(NULL AS VARCHAR[])"
        parts.append(f"SELECT raw_id, feed_id, {', '.join(f'{x} AS {c}' for x, c in zip(cols, columns, strict=True))}, {pts} AS pts FROM l WHERE feed_id = {n} AND regexp_full_match(line, '{_sql_pattern(n)}', 's')")
    part = lambda i: f"CAST(list_sum(list_transform(pts, lambda p: CAST(split_part(p, ',', {i}) AS BIGINT))) AS BIGINT)"
    return f"""WITH l AS (SELECT raw_id, feed_id, regexp_replace(raw_line, '\\r\\z', '') AS line FROM raw_record), v AS ({" UNION ALL ".join(parts)})
SELECT raw_id, feed_id, {", ".join(columns)}, len(pts) AS n_points, {part(1)} AS sum_x, {part(2)} AS sum_y FROM v"""


def _p1_reasons_sql() -> str:
    """Why each line is rejected: the first field whose prefix fails, told apart by the outer form of the fields."""
    kinds = {"hpos": "digits", "vpos": "digits", "width": "size", "height": "size", "points": "points", "wc": "ratio", "conf": "ratio", "region_type": "region_type"}
    feeds = []
    for n, (sep, quote, names) in _SQL_FEEDS.items():
        s, q, fields = {"\t": r"\t", "|": r"\|"}.get(sep, sep), quote.replace("'", "''"), names.split()
        form = f"(?:{q}(?:[^{q}]|{q}{q})*{q}|[^{s}{q}\\n]*)"
        cases = []
        for k, name in enumerate(fields, 1):
            prefix = s.join(_sql_field(f, sep, quote) for f in fields[:k]).replace("'", "''")
            bad = "bad_id" if name.endswith("_id") else f"bad_{kinds.get(name, 'text')}"
            shape = lambda m, end: f"regexp_matches(line, '\\A{s.join([form] * m)}{end}', 's')"  # noqa: B023, E731
            missing = f"WHEN {shape(k - 1, chr(92) + 'z')} THEN 'missing_fields'" if k > 1 else ""
            why = f"CASE {missing} WHEN NOT {shape(k, f'(?:{s}|{chr(92)}z)')} THEN 'broken_quoting' ELSE '{bad}' END"
            cases.append(f"WHEN NOT regexp_matches(line, '\\A{prefix}(?:{s}|\\z)', 's') THEN {why} || '/{name}'")
        feeds.append(f"WHEN {n} THEN CASE WHEN regexp_full_match(line, '{_sql_pattern(n)}', 's') THEN NULL {' '.join(cases)} ELSE 'extra_fields/' END")
    return f"""WITH l AS (SELECT raw_id, feed_id, regexp_replace(raw_line, '\\r\\z', '') AS line FROM raw_record),
w AS (SELECT feed_id, CASE WHEN line IS NULL THEN 'null_line/' ELSE CASE feed_id {" ".join(feeds)} ELSE 'unknown_feed/' END END AS why FROM l)
SELECT feed_id, split_part(why, '/', 1) AS reject_reason, nullif(split_part(why, '/', 2), '') AS reject_field, count(*) AS lines FROM w WHERE why IS NOT NULL GROUP BY ALL"""


def _p1_sql() -> str:
    when = []
    for n in _SQL_FEEDS:
        pattern = _sql_pattern(n)
        when.append(f"WHEN {n} THEN regexp_full_match(regexp_replace(raw_line, '\\r\\z', ''), '{pattern}', 's')")
    return f"SELECT raw_id FROM raw_record WHERE NOT CASE feed_id {' '.join(when)} ELSE false END"


_P2_SQL = r"""
WITH ref AS (
  SELECT 'mets_file' AS ref_table, 'file_dmdid' AS ref_field, mets_id, file_id AS row_key, recorded_at AS seen, unnest(regexp_split_to_array(file_dmdid, '\s+')) AS target_id FROM mets_file
  UNION ALL SELECT 'mets_file', 'grp_dmdid', mets_id, file_id, recorded_at, unnest(regexp_split_to_array(grp_dmdid, '\s+')) FROM mets_file
  UNION ALL SELECT 'mets_div', 'dmdid', mets_id, div_id, recorded_at, unnest(regexp_split_to_array(dmdid, '\s+')) FROM mets_div
  UNION ALL SELECT 'mets_fptr', 'file_id', mets_id, div_id, recorded_at, file_id FROM mets_fptr),
span AS (
  SELECT 'd' AS kind, mets_id, dmdid AS id, received_at AS since, deleted_at AS gone FROM mets_dmd
  UNION ALL SELECT 'f', mets_id, file_id, recorded_at, deleted_at FROM mets_file)
SELECT DISTINCT ref_table, ref_field, strftime(seen, '%Y-%m') AS ref_month, mets_id, row_key, target_id FROM ref r
WHERE trim(target_id) <> '' AND NOT EXISTS (
  SELECT 1 FROM span s WHERE s.kind = CASE ref_table WHEN 'mets_fptr' THEN 'f' ELSE 'd' END AND s.mets_id = r.mets_id
  AND s.id = r.target_id AND s.since <= r.seen AND (s.gone IS NULL OR r.seen < s.gone))"""

_P5_BLOCKS = """
WITH page AS (SELECT DISTINCT page_id, print_space AS ps FROM alto_page),
c1 AS (SELECT page_id, 'page' AS parent, 'cb:' || (i - 1) AS path, ps.composed_blocks[i] AS e FROM page, range(1, 100000) r(i) WHERE i <= len(ps.composed_blocks)),
c2 AS (SELECT page_id, path AS parent, path || '/cb:' || (i - 1) AS path, e.composed_blocks[i] AS e FROM c1, range(1, 100000) r(i) WHERE i <= len(e.composed_blocks)),
tb AS (
  SELECT page_id, 'page' AS parent, 'tb:' || (i - 1) AS path, ps.text_blocks[i] AS e FROM page, range(1, 100000) r(i) WHERE i <= len(ps.text_blocks)
  UNION ALL SELECT page_id, path, path || '/tb:' || (i - 1), e.text_blocks[i] FROM c1, range(1, 100000) r(i) WHERE i <= len(e.text_blocks)
  UNION ALL SELECT page_id, path, path || '/tb:' || (i - 1), e.text_blocks[i] FROM c2, range(1, 100000) r(i) WHERE i <= len(e.text_blocks)),
tl AS (SELECT page_id, path AS parent, path || '/tl:' || (i - 1) AS path, e.text_lines[i] AS e FROM tb, range(1, 100000) r(i) WHERE i <= len(e.text_lines)),
st AS (SELECT page_id, path AS parent, path || '/st:' || (i - 1) AS path, e.elems[i] AS e FROM tl, range(1, 100000) r(i) WHERE i <= len(e.elems))"""

_P5_SQL = (
    _P5_BLOCKS
    + """,
node AS (
  SELECT page_id, parent, path, e.points AS points FROM c1 UNION ALL SELECT page_id, parent, path, e.points FROM c2
  UNION ALL SELECT page_id, parent, path, e.points FROM tb UNION ALL SELECT page_id, parent, path, e.points FROM tl
  UNION ALL SELECT page_id, parent, path, e.points FROM st WHERE e.tag = 'String')
SELECT page_id, parent AS parent_path, path AS child_path FROM node
UNION ALL SELECT page_id, path, path || '/pt:' || (unnest(range(len(string_split_regex(trim(points), '\\s+')))) ) FROM node WHERE trim(points) <> ''"""
)

_P5_POINTS_SQL = _P5_SQL.split("\nSELECT page_id, parent AS parent_path")[0] + """
, pts AS (SELECT page_id, path, string_split_regex(trim(points), '\\s+') AS ps FROM node WHERE trim(points) <> ''), pt AS (SELECT page_id, path, ps, unnest(range(len(ps))) AS i FROM pts)
SELECT page_id, path AS parent_path, path || '/pt:' || i AS child_path, ps[i + 1] AS value FROM pt"""


def _p5_element_sql(code: str) -> str:
    """The flat table of one kind of block or line."""
    source = "(SELECT * FROM c1 UNION ALL SELECT page_id, parent, path, {'id': e.id, 'hpos': e.hpos, 'vpos': e.vpos, 'width': e.width, 'height': e.height, 'points': e.points} FROM c2)" if code == "cb" else code
    if code == "cb":
        source = source.replace("SELECT * FROM c1", "SELECT page_id, parent, path, {'id': e.id, 'hpos': e.hpos, 'vpos': e.vpos, 'width': e.width, 'height': e.height, 'points': e.points} AS e FROM c1")
    return f"{_P5_BLOCKS} SELECT page_id, parent AS parent_path, path AS child_path, e.id AS id, e.hpos AS hpos, e.vpos AS vpos, e.width AS width, e.height AS height, e.points AS points FROM {source} WHERE e IS NOT NULL"


_P5_STRINGS_SQL = (
    _P5_BLOCKS
    + """
SELECT page_id, parent AS parent_path, path AS child_path, e.id AS id, e.content AS content, e.hpos AS hpos, e.vpos AS vpos,
  e.width AS width, e.height AS height, e.wc AS wc, e.points AS points FROM st WHERE e.tag = 'String'"""
)

QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_rows, p2_found, p2_per_month, p5_found, p5_strings, p5_composed_blocks, p5_text_blocks, p5_text_lines, p5_points)}

ORACLES = {
    "p1_found": _p1_sql(),
    "p1_rejects": _p1_reasons_sql(),
    "p1_rows": _p1_rows_sql(),
    "p2_found": _P2_SQL,
    "p2_per_month": f"SELECT ref_table, ref_field, ref_month, count(*) AS orphans FROM ({_P2_SQL}) GROUP BY ALL",
    "p5_found": _P5_SQL,
    "p5_strings": _P5_STRINGS_SQL,
    "p5_composed_blocks": _p5_element_sql("cb"),
    "p5_text_blocks": _p5_element_sql("tb"),
    "p5_text_lines": _p5_element_sql("tl"),
    "p5_points": _P5_POINTS_SQL,
}
