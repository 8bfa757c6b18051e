import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import dates, similarity as sim, text as tx
from folioscope.plans.evaluation import parse_metrics, score


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).collect()[0].v


R = C = None


@pytest.fixture(autouse=True)
def columns(spark):
    """Columns can only be made once a session exists."""
    global R, C
    R, C = F.col("r"), F.col("c")


def test_known_similarities(spark):
    assert round(one(spark, sim.character_similarity(R, C), r="sthe lazy brown fox jumps overthe hump", c="fthe lazy brown fox jumps ouer the hump"), 2) == 92.31
    assert one(spark, sim.word_similarity(R, C), r="the lazy brown fox jumps over the hump", c="the fox lazy brown jumps over the hump") == 75.0
    assert round(one(spark, sim.bag_value(R, C), r="der Mann steht an der Ampel", c="cer Mann fteht an der Ampel"), 2) == 66.67
    assert round(one(spark, sim.bag_value(R, C), r="der Mann steht an der roten Ampel", c="cer Mann fteht an der Ampel"), 2) == 61.54
    assert round(one(spark, sim.bag_value(R, C), r="the dizzy brown fox jumps", c="the dizzy brown fox fox fox jumps"), 4) == 83.3333
    stop = ["the", "over"]
    assert one(spark, sim.precision(R, C, stop), r="the lazy brown fox jumps over the hump", c="the red fox") == 50.0
    assert one(spark, sim.recall(R, C, stop), r="the lazy brown fox jumps over the hump", c="the red fox") == 20.0


@pytest.mark.parametrize(("r", "c", "want"), [("", "", (100.0, 100.0, 100.0, 0.0, None)), ("a b", "", (0.0, 0.0, 0.0, 0.0, 0.0)), (None, "a", (None, None, None, None, None))])
def test_empty_and_null_texts(spark, r, c, want):
    cols = [sim.character_similarity(R, C), sim.word_similarity(R, C), sim.bag_value(R, C), sim.precision(R, C, []), sim.recall(R, C, [])]
    row = spark.createDataFrame([(r, c)], "r string, c string").select(*[x.alias(f"v{i}") for i, x in enumerate(cols)]).collect()[0]
    assert tuple(row)[:3] == want[:3] and (r is None or tuple(row) == want)


def test_bag_by_join_equals_bag_in_row(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(6))), " ".join(rnd.choice("abc") for _ in range(rnd.randrange(6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, r string, c string")
    a = {r.k: r.value for r in sim.bag_similarity(df, "k", "r", "c").collect()}
    b = {r.k: r.v for r in df.select("k", sim.bag_value(R, C).alias("v")).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_sequence_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    assert sim.sequence_distance(a, b) == row[-1]


def test_spell_checker_is_injected(spark):
    df = spark.createDataFrame([(1, "a bb ccc"), (2, ""), (3, None)], "k long, t string")
    got = {r.k: (r.value, r.n_ref) for r in sim.dictionary_similarity(df, "k", "t", lambda: lambda text: text.count("b")).collect()}
    assert {k: (round(v, 3), n) for k, (v, n) in got.items()} == {1: (33.333, 3), 2: (100.0, 0), 3: (100.0, 0)}


def test_text_steps(spark):
    assert one(spark, tx.letters(F.col("x")), x="A 2!\n") == "A"
    assert tuple(one(spark, tx.class_removals(F.col("x")), x="A 2!\n")) == (2, 1, 1)
    assert one(spark, tx.normalized_whitespace(F.col("x")), x="a\r\nb\rc\n\td") == "a b c \td"
    assert one(spark, tx.tokens(F.col("x")), x=" a b\x85c  ") == ["a", "b", "c"]
    assert one(spark, tx.vowels_composed(F.col("x")), x="Auͤs uͤ oͤ") == "Aüs ü ö"
    with pytest.raises(Exception, match="no vowel"):
        one(spark, tx.vowels_composed(F.col("x")), x="xͤ")
    assert one(spark, tx.unwrapped(F.split(F.col("x"), "\n")), x="a b-\nc-\nd e⸗\n\nf-") == ["a bc-", "", "d e⸗", "", "f-"]
    assert one(spark, tx.unwrapped(F.split(F.col("x"), "\n")), x="sachsen-\nstolz ist—\nes") == ["sachsenstolz", "istes", ""]
    assert one(spark, tx.dictionary_line(F.col("x")), x=" 12 Der, M1ann! a  (ist)") == "Der, Mann ist"
    assert one(spark, tx.one_line(F.col("x")), x=" a \n\n b\n") == "a  b"
    assert one(spark, tx.reordered(F.col("x")), x="a b  c") == "c b a"
    assert one(spark, tx.without_marks(F.col("x")), x="‏ab‌﻿") == "ab"
    assert one(spark, tx.pair_prefix(F.col("x")), x="0012") == "page12" and one(spark, tx.pair_prefix(F.col("x"), "p"), x="x1") == "x1"
    assert len(one(spark, tx.normalized_encoding(F.col("x"), "NFKD"), x="ä")) == 2
    assert one(spark, tx.step_line(tx.step_report("letters", F.col("x"), tx.letters(F.col("x")))), x="a 1") == "letters: 3 characters -> 1 characters"


def test_dates(spark):
    df = spark.createDataFrame([(y,) for y in ("0100", "0101", "1700", "1701", "1800", "1801", "2000", "2001", " 1867-01-01", "unknown", "1101", None)], "d string")
    assert [r.c for r in df.select(dates.century(F.col("d")).alias("c")).collect()] == ["1st", "2nd", "17th", "18th", "18th", "19th", "20th", "21st", "19th", None, "12th", None]
    assert [r.c for r in df.select(dates.decade(F.col("d")).alias("c")).collect()][8:] == ["1860s", None, "1100s", None]


def test_measure_names_and_scores(spark):
    assert parse_metrics("Characters, Ls,Cs") == ["Cs", "Ls"]
    with pytest.raises(ValueError, match="Xs"):
        parse_metrics("Cs,Xs")
    df = spark.createDataFrame([("p", "Haus am See", "Haus an See"), ("q", "", "")], "id string, text_reference string, text_candidate string")
    got = {(r.id, r.metric): (round(r.value, 2), r.n_ref) for r in score(df, ["Cs", "Ls", "Ws", "BoWs", "IRPre", "IRRec", "IRF"], ["am"]).collect()}
    assert got["p", "Cs"] == (90.91, 11) and got["p", "Ls"] == (88.89, 9) and got["p", "Ws"] == (66.67, 3) and got["p", "IRPre"] == (66.67, 2) and got["p", "IRRec"] == (100.0, 2)
    assert ("q", "IRRec") not in got and got["q", "Cs"] == (100.0, 0)
