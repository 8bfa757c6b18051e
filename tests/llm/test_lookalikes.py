import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm import lookalikes as lk  # noqa: E402
from folioscope.llm.characters import plain_form, word_form  # noqa: E402

A = "string_rid long, mets_id long, page_no int, content string"
P = "line_rid long, mets_id long, page_no int, text_equiv string"
LEX = [("ger", "die"), ("ger", "für"), ("ger", "Korn"), ("eng", "a"), ("rus", "а"), ("rus", "весна"), ("per", "می‌شود"), ("ara", "بين")]


def rows_of(spark, words, lines=()):
    return lk.page_texts(spark.createDataFrame(list(words), A), spark.createDataFrame(list(lines), P))


def test_cases_and_texts(spark):
    words = [(1, 1, 1, "die"), (2, 1, 1, "dіе"), (3, 1, 1, "ｄｉｅ"), (4, 1, 1, "für"), (5, 1, 1, "fu\u0308r"), (6, 1, 1, "\u212aorn"), (7, 1, 1, "ſo"), (8, 1, 1, "fuͤr"), (9, 1, 1, "m²"), (10, 1, 1, "½"),
             (11, 1, 1, "„die“"), (12, 1, 1, "Wuzz­mark,"), (13, 1, 1, "а"), (14, 2, 1, "а"), (15, 2, 1, "вecнa"), (16, 2, 1, "весна"), (17, 3, 1, "می‌شود"), (18, 3, 1, "می‌شو​د"),
             (19, 4, 1, "بین"), (20, 4, 1, "بينة"), (21, 1, 1, None), (22, 1, 1, ""), (23, 1, 1, " "), (24, 1, 1, "nicht．"), (2, 1, 1, "dіе"), (25, 1, 1, "１７８９"), (26, 1, 1, "183B")]
    lines = [(1, 1, 1, "die\u00a0Korn"), (2, 1, 1, "die Korn"), (3, 1, 1, "die — Korn⸗"), (4, 1, 1, "x" * 5000 + "​")]
    rows, lex = rows_of(spark, words, lines), spark.createDataFrame(LEX, "lang string, word string")
    got = {(r.tbl, r.row_id) for r in lk.lookalike_rows(rows, lex).collect()}
    assert got == {("alto_string", i) for i in (2, 3, 5, 6, 12, 13, 15, 18, 19, 24, 25)} | {("page_line", 1), ("page_line", 4)}
    text = {(r.tbl, r.row_id): r.text for r in lk.normalised_rows(rows, lex).collect()}
    assert text["alto_string", 3] == "die" and text["alto_string", 12] == "Wuzzmark," and text["page_line", 1] == "die Korn" and text["alto_string", 24] == "nicht." and text["alto_string", 15] == "весна"
    assert text["alto_string", 19] == "بين" and text["page_line", 4] == "x" * 5000


def test_empty_tables(spark):
    rows = rows_of(spark, [])
    assert lk.lookalike_rows(rows, spark.createDataFrame([], "lang string, word string")).count() == 0


def test_forms():
    assert word_form("Когда") == word_form("Kогда") == word_form("когда") and word_form("Waſſeruͤ") == "wasserü"
    assert plain_form("тaкжe", "Cyrl") == "также" and plain_form("газета", "Latn") == "газета" and plain_form("ᴀ", "Latn") == "ᴀ"
