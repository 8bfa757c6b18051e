import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm import scanned, vocabulary  # noqa: E402

A = "string_rid long, mets_id long, page_no int, line_ord int, string_ord int, content string"
P = "line_rid long, mets_id long, page_no int, line_ord int, text_equiv string"
BODY = ["der alte Mann kam aus dem Haus", "sie gingen durch den langen Wald", "am Abend war alles wieder still", "niemand wusste mehr davon zu sagen"]


def furniture(spark, pages):
    rows = [(100 * n + i, 1, n, i, t) for n, page in enumerate(pages, 1) for i, t in enumerate(page)]
    lines = scanned.page_words(spark.createDataFrame([], A), spark.createDataFrame(rows, P))
    return {r.page_no: sorted(r.furniture) for r in scanned.page_furniture(lines).collect()}


def test_head_below_and_foot_above_the_number(spark):
    body = lambda n: [BODY[(n + k) % 4] + " " + "abcdefgh"[n] * (5 + 3 * k) for k in range(3)]
    heads = [[str(n + 12), "Land und Amt", *body(n)] for n in range(1, 5)]
    assert furniture(spark, heads) == {n: [0, 1] for n in range(1, 5)}
    feet = [[*body(n), "Druck von Wuzzmark", str(n + 12)] for n in range(1, 5)]
    assert furniture(spark, feet) == {n: [3, 4] for n in range(1, 5)}
    swapped = [[*body(n), str(n + 12), "Druck von Wuzzmark"] for n in range(1, 5)]
    assert furniture(spark, swapped) == {n: [3, 4] for n in range(1, 5)}
    plain = [[str(n + 12), *body(n), str(n + 12)] for n in range(1, 5)]
    assert furniture(spark, plain) == {n: [0, 4] for n in range(1, 5)}
    chance = [[*body(n), ["so!", "so."][n // 2] if n in (1, 3) else BODY[n - 1], str(n + 12)] for n in range(1, 5)]
    assert furniture(spark, chance) == {n: [4] for n in range(1, 5)}


WORDS = "Acker Bach Damm Eiche Furt Graben Hecke Insel Joch Kamm Lehm Moor Nest Ofen Pfad Quelle Rain Sumpf Tal Ufer Vieh Wald Zaun".split()


def prose(n, k):
    """A line that no other page has."""
    return " ".join(WORDS[(n * 7 + k * 5 + i * (1 + n % 5)) % len(WORDS)] for i in range(7))


def test_head_on_every_seventh_scan(spark):
    head = lambda n: ["Von den Bergwerken", "Von den Borgwerken", "Von dcn Bergwerken"][n // 7 % 3]
    pages = [[*([head(n)] if n % 7 == 0 else []), *[prose(n, k) for k in range(12)]] for n in range(1, 43)]
    assert furniture(spark, pages) == {n: [0] if n % 7 == 0 else [] for n in range(1, 43)}


def test_heads_and_feet_of_two_lines(spark):
    pages = [["Chronik der Stadt", "Zweiter Theil", *[prose(n, k) for k in range(9)], "Gedruckt im Jahre", "bey Johann Wuzzmark"] for n in range(1, 43)]
    assert furniture(spark, pages) == {n: [0, 1, 11, 12] for n in range(1, 43)}
    # Lines further in do not count where the line outside them is the text's own.
    pages = [[*[prose(n, k) for k in range(9)], "Gedruckt im Jahre", prose(n, 20)] for n in range(1, 10)]
    assert furniture(spark, pages) == {n: [] for n in range(1, 10)}


def test_rows_without_a_place_make_pages_of_their_own(spark):
    rows = [(1, None, 3, 1, "a b"), (2, 5, None, 1, "c"), (3, 5, 3, None, "d"), (4, None, None, None, None), (5, 5, 3, 1, "e"), (5, 5, 3, 1, "e")]
    pages = scanned.page_words(spark.createDataFrame([], A), spark.createDataFrame(rows, P)).collect()
    assert sorted((r.lone or 0, len(r.lines), sum(len(x.words) for x in r.lines)) for r in pages) == [(0, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 1, 0)]
    s = scanned.Scans(spark.createDataFrame([], A), spark.createDataFrame(rows, P), spark.createDataFrame([], "lang string, word string"))
    assert {(r.row_id, r.kind) for r in s.found().collect()} == set()


def test_words_met_by_shuffle_and_by_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "und" if i % 3 else f"w{i % 40}") for i in range(600)] + [(999, None)], "id long, tok string")
    words = spark.createDataFrame([("und", 1), ("w3", 2), ("w9", 3), ("no", 4)], "word string, n int")
    for how in ("left", "inner"):
        want = sorted(map(tuple, vocabulary.meet(rows, rows["tok"], words, "word", how).collect()), key=repr)
        monkeypatch.setattr(vocabulary, "BROADCAST_WORDS", 0)
        assert sorted(map(tuple, vocabulary.meet(rows, rows["tok"], words, "word", how).collect()), key=repr) == want
        monkeypatch.setattr(vocabulary, "BROADCAST_WORDS", 200_000)


def test_a_misread_conjunction_still_parts_a_compound(spark):
    text = ["der Landbe- und", "die Land-", "uud Amtsordnung kam"]
    rows = [(i, 1, 1, i, t) for i, t in enumerate(text)]
    lex = spark.createDataFrame([("ger", w) for w in ["der", "die", "Land", "und", "kam", "Amt", "oder", "Ordnung"]], "lang string, word string")
    s = scanned.Scans(spark.createDataFrame([], A), spark.createDataFrame(rows, P), lex)
    assert "joined" not in {r.kind for r in s.found().collect()}
