import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators.raw_rows import Feed, broken_rows, check_rows, read_feeds, typed_rows

A = Feed(1, ",", '"', ("string_id", "content", "hpos", "width", "wc"))
B = Feed(2, ",", '"', ("word_id", "points", "content"))
C = Feed(3, "|", "'", ("region_id", "region_type", "points", "text_equiv"))
SCHEMA = "raw_id long, feed_id int, raw_line string"

GOOD = [
    (1, 'a1,text,0,5,0.5'), (1, '_a,,10,1,'), (1, '"a","x ""y"", z","3","4","1"\r'), (1, 'a,"two\nlines",1,1,1.000'), (1, "a,tab\there,1,1,0"),
    (2, 'w,"1,2 3,4  5,6 ",x'), (2, 'w," 1,2 3,4 5,6",""'), (3, "r|TextRegion|1,2 3,4 5,6|x"),
    (3, "r|'TableCell'|'1,2 3,4 5,6'|'a | ''b'''"),
]
BAD = [
    (1, "1a,x,0,5,0", "bad_id", "string_id"), (1, "a,x,0,0,0", "bad_size", "width"), (1, "a,x,-1,5,0", "bad_digits", "hpos"), (1, "a,x,1,5,1.5", "bad_ratio", "wc"),
    (1, "a,x,1,5,0.", "bad_ratio", "wc"), (1, "a,x,1,5", "missing_fields", "wc"), (1, "a,x,1,5,0,", "extra_fields", None), (1, 'a,"x,1,5,0', "broken_quoting", "content"),
    (1, 'a,x"y,1,5,0', "broken_quoting", "content"), (1, "a,x\x07,1,5,0", "bad_text", "content"), (1, "a,x�,1,5,0", "bad_text", "content"), (1, "a,x\r\r", "bad_text", "content"),
    (1, "a,x\ny,1,5,0", "broken_quoting", "content"), (1, "", "bad_id", "string_id"), (2, "w,1,2 3,4 5,6,x", "bad_points", "points"), (2, 'w,"1,2 3,4",x', "bad_points", "points"),
    (3, "r|Image|1,2 3,4 5,6|x", "bad_region_type", "region_type"), (9, "a", "unknown_feed", None), (None, "a", "unknown_feed", None), (1, None, "null_line", None),
    (1, "a,x,٣,5,0", "bad_digits", "hpos"),
]


def test_good_and_broken_rows(spark):
    rows = [(i, f, line) for i, (f, line) in enumerate(GOOD)] + [(100 + i, f, line) for i, (f, line, _, _) in enumerate(BAD)]
    got = {r.raw_id: (r.reject_reason, r.reject_field) for r in check_rows(spark.createDataFrame(rows, SCHEMA), [A, B, C]).collect()}
    assert {i: got[i] for i in range(len(GOOD))} == {i: (None, None) for i in range(len(GOOD))}
    for i, (_, line, reason, field) in enumerate(BAD):
        assert got[100 + i] == (reason, field), line


def test_typed_values(spark):
    df = spark.createDataFrame([(1, 1, '"a","x ""y""","3","4",""'), (2, 1, "b,z,99999999999999999999,1,1")], SCHEMA)
    assert [tuple(r) for r in typed_rows(df, A).orderBy("raw_id").collect()] == [(1, "a", 'x "y"', 3, 4, None), (2, "b", "z", None, 1, 1.0)]
    p = typed_rows(spark.createDataFrame([(1, 2, 'w," 1,2 3,4  5,6 ",x')], SCHEMA), B).collect()[0].points
    assert [tuple(x) for x in p] == [(1, 2), (3, 4), (5, 6)]


def test_long_text_and_clashing_names(spark):
    text = "ab\"\"" * 300_000
    df = spark.createDataFrame([(1, 1, f'a,"{text}",1,1,0'), (2, 1, f'a,"{text},1,1,0')], SCHEMA).withColumn("reject_reason", F.lit("mine")).withColumn("content", F.lit(7))
    out = check_rows(df, [A])
    got = {r.raw_id: r for r in out.collect()}
    assert got[1].reject_reason == "mine" and got[1].reject_reason_ is None and got[2].reject_reason_ == "broken_quoting"
    assert "content_" in typed_rows(df, A, keep=("raw_id", "content")).columns


def test_empty_and_repeated(spark):
    assert broken_rows(spark.createDataFrame([], SCHEMA), [A]).count() == 0
    assert broken_rows(spark.createDataFrame([(1, 1, "x"), (1, 1, "x")], SCHEMA), [A]).count() == 2
    feeds = spark.createDataFrame([(1, "a", ",", '"', "x_id, content")] * 2, "feed_id int, feed_name string, sep_char string, quote_char string, field_names string")
    assert read_feeds(feeds) == [Feed(1, ",", '"', ("x_id", "content"))]


def test_against_a_parser_by_hand(spark):
    """Every short line over a small alphabet, against a character-by-character reading."""
    import itertools

    feed = Feed(1, ",", '"', ("content", "wc"))

    def valid(line):
        fields, at = [], 0
        while True:
            if at < len(line) and line[at] == '"':
                m = re.compile(r'"((?:[^"]|"")*)"(?=,|\Z)').match(line, at)
                if not m:
                    return False
                fields.append(m[1].replace('""', '"'))
                at = m.end()
            else:
                m = re.compile(r'[^,"\n]*').match(line, at)
                fields.append(m[0])
                at = m.end()
            if at == len(line):
                break
            if line[at] != ",":
                return False
            at += 1
        return len(fields) == 2 and re.fullmatch(r"|0|1", fields[1]) is not None

    lines = ["".join(t) for n in range(7) for t in itertools.product('a",0', repeat=n)]
    df = spark.createDataFrame([(i, 1, x) for i, x in enumerate(lines)], SCHEMA)
    bad = {r.raw_id for r in broken_rows(df, [feed]).select("raw_id").collect()}
    wrong = [x for i, x in enumerate(lines) if (i in bad) == valid(x)]
    assert not wrong


@pytest.mark.parametrize("quote", ["a", "1"])
def test_impossible_layout(quote):
    from folioscope.operators.raw_rows import row_pattern

    with pytest.raises(ValueError):
        row_pattern(Feed(1, ",", quote, ("x_id",)))
