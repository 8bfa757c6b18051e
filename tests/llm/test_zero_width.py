import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm import lookalikes as lk  # noqa: E402


def test_signs_without_width_that_stand_alone(spark):
    words = [(1, 1, 1, "word.\u200b"), (2, 1, 1, "word.\u200b"), (3, 1, 1, "a \u2060 b"), (4, 1, 1, "\ufeff"), (5, 1, 1, "word."), (6, 1, 1, "—")]
    lines = spark.createDataFrame([], "line_rid long, mets_id long, page_no int, text_equiv string")
    rows = lk.page_texts(spark.createDataFrame(words, "string_rid long, mets_id long, page_no int, content string"), lines)
    lex = spark.createDataFrame([("eng", "word")], "lang string, word string")
    assert {r.row_id for r in lk.lookalike_rows(rows, lex).collect()} == {1, 2, 3, 4}
    text = {r.row_id: r.text for r in lk.normalised_rows(rows, lex).collect()}
    assert text == {1: "word.", 2: "word.", 3: "a  b", 4: "", 5: "word.", 6: "—"}
