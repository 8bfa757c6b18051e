import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm.scanned import Scans  # noqa: E402

A = "string_rid long, mets_id long, page_no int, line_ord int, string_ord int, content string"
P = "line_rid long, mets_id long, page_no int, line_ord int, text_equiv string"
LEX = ["Land", "Amt", "Landbesitzer", "oder", "und", "der", "die", "kam", "gesammelt", "wurde", "nicht", "Vertrag", "Ordnung", "das", "Haus", "alte", "lange", "heute", "weil"]


def pages():
    """Six pages with running head and number, a chapter that opens on the fourth, and broken words."""
    out = []
    for n in range(1, 7):
        head = ["Land und Amt", "Land nud Amt", "Land und Amt", "Haus Wuzzmark", "Land und Amt", "Land und Amt"][n - 1]
        body = {
            1: ["der alte Landbe⸗", "sitzer kam und die Land-", "oder Amtsordnung gesam"], 2: ["melt wurde. 1794.", "das Haus uud der Vertrag Wuzzmark", "die lange Ord⸗"],
            3: ["nung wurde nicht gesammelt", "  ", "1597."], 4: ["der Vertrag l794 kam", "weil das Haus Zolvanitz kam"], 5: ["heute wurde Wuzzmark Zolvanitz alte", "das Haus"], 6: ["die Land", "und das Haus 17"],
        }[n]
        lines = [head, *body, f"— {n + 12} —"] if n == 4 else [head, f"— {n + 12} —", *body]
        out += [(n, i, t) for i, t in enumerate(lines)]
    return out


@pytest.fixture(scope="module")
def scans(spark):
    lines = [(100 * p + i, 1, p, i, t) for p, i, t in pages()]
    lines += [lines[5], (9001, 2, 1, 0, None), (9002, 2, 1, 1, "Wuzzmark Wuzzmark Wuzzmark Zolvanitz Zolvanitz Zolvanitz Zolvanitz")]
    words = [(10000 * p + 100 * i + k, 1, 5000 + p, i, k, w) for p, i, t in pages() for k, w in enumerate(t.split())]
    lex = spark.createDataFrame([("ger", w) for w in LEX], "lang string, word string")
    return Scans(spark.createDataFrame(words, A), spark.createDataFrame(lines, P), lex)


def test_found(scans):
    got = {(r.tbl, r.row_id, r.kind) for r in scans.found().collect()}
    line = {(i, k) for t, i, k in got if t == "page_line"}
    assert {i for i, k in line if k == "furniture"} == {100, 101, 200, 201, 300, 301, 403, 500, 501, 600, 601}
    assert {i for i, k in line if k == "joined"} == {102, 104, 204}
    assert {i for i, k in line if k == "misread"} == {203, 401}
    word = {(i, k) for t, i, k in got if t == "alto_string"}
    assert {i for i, k in word if k == "joined"} == {10202, 10402, 20402} and {i for i, k in word if k == "misread"} == {20302, 40102}
    assert (40000, "furniture") not in word and (40300, "furniture") in word and (20001, "furniture") in word


def test_paragraphs(scans):
    text = {(r.tbl, r.page_no, r.para_no): r.text for r in scans.paragraphs().filter("mets_id = 1").collect()}
    first = text["page_line", 1, 0]
    assert first == "der alte Landbesitzer kam und die Land- oder Amtsordnung gesammelt"
    assert text["alto_string", 5001, 0] == first and any("das Haus und der Vertrag Wuzzmark" in t for t in text.values())


def test_empty_tables(spark):
    s = Scans(spark.createDataFrame([], A), spark.createDataFrame([], P), spark.createDataFrame([], "lang string, word string"))
    assert s.found().count() == 0
