"""Scanned pages as continuous text: no running heads, feet and page numbers, broken words whole,
misread words put right.

* Page numbers: a number at the edge of a page whose difference to the scan's number is one that
  recurs in the work.
* Running heads and feet: the line at the edge, or the one next to a page number there, that recurs
  fuzzily at that edge of one of the four scans before or after, or, where it stands alone among its
  neighbours, often enough around or in the whole work (``_recurring_afar``). Lines further in, up to
  ``EDGE_LINES`` from the edge, belong to it as well if all lines outside them do and they recur on two
  neighbouring scans or as often. The first of a run that opens a
  chapter (no number at the top where the work has it there, or another head before it) is a section
  heading and stays.
* Broken words: a line whose last word ends in a hyphen, unless a conjunction follows ("Land- und");
  without a hyphen, where the two parts make a word of the vocabulary and are none themselves.
* Misread words: a word that is neither in the lexicon nor a name of the corpus (a frequent word that
  is no near miss of a more frequent one), and is a near miss of a word that is.

Pages are kept by blocks of ``BLOCK`` scans. Work-wide counts are summed up per block, then per work,
and handed back to the blocks, so that no step gathers a work: a work with a third of all pages is
spread like any other. Words meet the vocabulary through ``vocabulary.meet``, which parts frequent words from
the others, so that no word is gathered either.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .characters import BLANK_CLASS, ZERO_WIDTH, _BMP_WIDE, word_form
from .vocabulary import is_small, meet

#: Scans before and after a page on which its edge lines are sought one by one.
REACH = 4
#: Scans that one block holds.
BLOCK = 64
#: Lines at the upper and at the lower edge of a page that may be heads and feet.
EDGE_LINES = 4
#: Scans of its own and the two blocks beside it on which a line must stand at the edge if no neighbour has it.
CLOSE_PAGES = 5
#: Scans of the whole work on which it must stand otherwise, and of how many scans it must be on one.
FAR_PAGES, FAR_SPACING = 3, 24
#: Letters of a line up to which it may differ in a letter, beyond which in a word.
SHORT = 30
#: Share of a head's characters that may differ between two pages.
HEAD_DIFFERENCE = 0.2
#: Least count in the corpus of a word outside the lexicon that is taken for a name.
NAME_COUNT = 5
#: A word so many times as frequent makes a rare near miss of it a misreading.
DOMINANCE = 10

# Signs that break a word at the end of a line.
HYPHENS = "-⸗=¬‐‑­"
# Words before which a hyphen stands for the rest of a compound.
CONJUNCTIONS = ("und", "oder", "bzw", "sowie", "and", "or", "et", "ou", "и", "или", "و", "أو", "یا")
# What is read for what, in two orders, since some of them overlap ("nicli", "smd").
# Both forms of a pair become the same in a word's skeleton.
_SINGLE = (
    ("1", "l"), ("|", "l"), ("!", "l"), ("i", "l"), (";", "l"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("q", "g"),
    ("f", "s"), ("c", "e"), ("n", "u"), ("t", "r"), ("ä", "a"), ("ö", "o"), ("ü", "u"),
)
CONFUSIONS = (
    (("rn", "m"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("ss", "ff"), *_SINGLE),
    (("li", "h"), ("rn", "m"), ("in", "m"), ("ni", "m"), ("nn", "m"), ("vv", "w"), ("ſſ", "ff"), *_SINGLE),
)
#: Digits that letters are read for.
_DIGITS = ("OoQDlI|iZzSsBbGgqT", "000011112255886997")

_PAGE = ["tbl", "mets_id", "page_no"]
_KEY = ["tbl", "mets_id", "block", "page_no", "lone"]


def page_words(alto_string: DataFrame, page_line: DataFrame) -> DataFrame:
    """Pages (tbl, mets_id, block, page_no, lone, lines) of both page tables; lines = array of (line_ord,
    ids, words) in order, words = array of (id, tok).

    Rows that stand again count once; rows without text keep their place in ``ids`` only. A row of
    which work, page or line is null has no place on any page: it makes a page of its own (``lone`` is
    its id). Copies of a row fall together before anything is shuffled.
    """
    a = alto_string.select(F.lit("alto_string").alias("tbl"), "mets_id", "page_no", "line_ord", F.col("string_ord").alias("ord"), F.col("string_rid").alias("row_id"), F.col("content").alias("text"))
    p = page_line.select(F.lit("page_line").alias("tbl"), "mets_id", "page_no", "line_ord", F.lit(0).alias("ord"), F.col("line_rid").alias("row_id"), F.col("text_equiv").alias("text"))
    placed = F.col("mets_id").isNotNull() & F.col("page_no").isNotNull() & F.col("line_ord").isNotNull()
    rows = a.unionByName(p).filter(F.col("row_id").isNotNull()).distinct()
    rows = rows.withColumns({"block": F.floor(F.col("page_no") / BLOCK), "lone": F.when(~placed, F.col("row_id"))})
    rows = rows.repartition("tbl", "mets_id", "block", "lone")
    lines = rows.groupBy(*_KEY, "line_ord").agg(F.sort_array(F.collect_list(F.struct("ord", "row_id", "text"))).alias("rows"))
    toks = lambda r: F.filter(F.split(F.coalesce(r["text"], F.lit("")), BLANK_CLASS + "+"), lambda t: t != "")
    words = F.flatten(F.transform("rows", lambda r: F.transform(toks(r), lambda t: F.struct(r["row_id"].alias("id"), t.alias("tok")))))
    line = F.struct("line_ord", F.array_distinct(F.transform("rows", lambda r: r["row_id"])).alias("ids"), words.alias("words"))
    return lines.select(*_KEY, line.alias("line")).groupBy(*_KEY).agg(F.sort_array(F.collect_list("line")).alias("lines"))


def _edge_text(words: Column) -> Column:
    x = F.array_join(F.transform(words, lambda w: w["tok"]), " ")
    return F.translate(x, "".join(_BMP_WIDE) + ZERO_WIDTH, "".join(_BMP_WIDE.values()))


_NUMBER = r"([0-9OolI|SsBZqgTi]{1,6}|[ivxlcdm1]{1,12})"
_WHOLE = rf"\A[\[(—–\-\s]*(?:(?:Seite|S\.|Page|p\.|[A-Za-z]{{4,5}})\s)?\s*{_NUMBER}[\]).—–\-\s]*\z"
_LAST = rf"\A(.*\S)\s+(?:(?:Seite|S\.|Page|p\.)\s)?[\[(—–\-\s]*{_NUMBER}[\]).—–\-\s]*\z"
_FIRST = rf"\A[\[(—–\-\s]*{_NUMBER}[\]).—–\-]*\s+(\S.*)\z"


def _value(token: Column) -> Column:
    """The number a token stands for, in digits or in Roman numerals; null if it is none."""
    roman = F.lit(0)
    low = F.lower(F.translate(token, "1|", "ll"))
    count = lambda s: (F.length(low) - F.length(F.replace(low, F.lit(s), F.lit("")))) / len(s)
    for letter, value in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True):
        roman = roman + value * count(letter)
    for pair, value in (("iv", 2), ("ix", 2), ("xl", 20), ("xc", 20), ("cd", 200), ("cm", 200)):
        roman = roman - value * count(pair)
    arabic = F.translate(token, *_DIGITS).try_cast("int")
    return F.when(token.rlike("[0-9]"), arabic).when(token.rlike(r"\A[ivxlcdm]+\z"), roman.cast("int"))


def _near(a: Column, b: Column, least: int = 1) -> Column:
    room = F.greatest(F.lit(least), F.floor(F.greatest(F.length(a), F.length(b)) * HEAD_DIFFERENCE)).cast("int")
    # Beyond ``room`` the distance is not worked out (-1).
    return F.coalesce((F.abs(F.length(a) - F.length(b)) <= room) & (F.call_function("levenshtein", a, b, room) >= 0), F.lit(False))


def _lettered(text: Column) -> Column:
    """Whether a line is text: four letters or more, which make up half of it."""
    n = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce((n >= 4) & (2 * n >= F.length(text)), F.lit(False))


def _per_work(pages: DataFrame, work: DataFrame) -> DataFrame:
    """``pages`` with the columns of ``work`` (tbl, mets_id, …), which are handed to each block of scans first."""
    blocks = pages.select("tbl", "mets_id", "block").distinct()
    return pages.join(blocks.join(work, ["tbl", "mets_id"]), ["tbl", "mets_id", "block"], "left")


def _with_numbers(pages: DataFrame) -> DataFrame:
    """Adds which edge lines hold the page's number: ``{l1,l2,ly,lz}_whole_no``, ``last_no``, ``first_no``."""
    names = ("l1_whole", "l2_whole", "ly_whole", "lz_whole", "last", "first")
    seen = F.array_compact(F.array_distinct(F.array(*[_value(F.col(c)) - F.col("page_no") for c in names])))
    diffs = (
        pages.select("tbl", "mets_id", F.explode(seen).alias("diff")).groupBy("tbl", "mets_id", "diff").agg(F.count("*").alias("n"))
        .groupBy("tbl", "mets_id").agg(F.max(F.struct("n", "diff")).alias("best")).filter("best.n >= 2").select("tbl", "mets_id", F.col("best.diff").alias("diff"))
    )
    pages = _per_work(pages, diffs)
    expected = F.col("page_no") + F.col("diff")

    def printed(c: str) -> Column:
        same = _value(F.col(c)) == expected
        close = F.col(c).rlike("[0-9]") & (F.length(c) == F.length(expected.cast("string"))) & (F.levenshtein(F.translate(F.col(c), *_DIGITS), expected.cast("string")) <= 1) & (F.length(c) >= 2)
        return F.coalesce(same | close, F.lit(False))

    return pages.withColumns({f"{c}_no": printed(c) for c in names}).drop(*names, "diff")


def _recurring_afar(lone: DataFrame, scans: DataFrame) -> DataFrame:
    """Of the edge lines (tbl, mets_id, block, page_no, side, at, text) those that recur at the same place, equal
    in all but one letter or, if they are longer than ``SHORT``, but a short word: on ``CLOSE_PAGES`` scans of their own and
    the two blocks beside it, or in the whole work on ``FAR_PAGES`` scans and on one of ``FAR_SPACING``.

    The more scans a work has, the more lines of its text are alike by chance; so the whole work asks for a
    share of its ``scans`` (tbl, mets_id, scans). Each line has a key for its skeleton and for what is left of
    it without each letter or short word; the keys are counted per block first, so lines never meet in pairs.
    """
    x = F.trim(_skeleton(F.regexp_replace("text", r"[^\p{L}\p{M}\p{N} ]", "")))
    lone = lone.select("tbl", "mets_id", "block", "page_no", "side", "at", x.alias("x")).withColumn("words", F.split("x", " +"))
    but = lambda a, i: F.concat(F.slice(a, F.lit(1), i), F.slice(a, i + 2, F.size(a)))
    less = F.transform("words", lambda w, i: F.array_join(but(F.col("words"), i), " "))
    # A word that makes up much of the line tells it from others, as in headings of one form.
    less = F.filter(less, lambda t: F.length(t) >= 0.7 * F.length("x"))
    keys = F.when(F.length("x") <= SHORT, _deletions(F.col("x"), twice=False)).otherwise(F.transform(F.array_distinct(F.concat(F.array("x"), less)), lambda t: F.xxhash64(t)))
    rows = cut(lone.withColumn("key", F.explode(F.array_distinct(keys))).drop("x", "words"))
    by = ["tbl", "mets_id", "side", "at", "key"]
    block = rows.groupBy(*by, "block").agg(F.count("*").alias("n"))  # a page has a place and key once
    beside = block.withColumn("block", F.explode(F.array(*[F.col("block") + d for d in (-1, 0, 1)])))
    close = beside.groupBy(*by, "block").agg(F.sum("n").alias("n")).filter(F.col("n") >= CLOSE_PAGES).select(*by, "block")
    work = block.groupBy(*by).agg(F.sum("n").alias("n")).filter(F.col("n") >= FAR_PAGES).join(scans, ["tbl", "mets_id"])
    work = block.select(*by, "block").join(work.filter(F.col("n") * FAR_SPACING >= F.col("scans")).select(*by), by)
    often = close.unionByName(work)
    return rows.join(often, [*by, "block"], "left_semi").select(*_PAGE, F.concat("side", "at").alias("place")).groupBy(*_PAGE).agg(F.collect_set("place").alias("afar"))


def page_furniture(pages: DataFrame) -> DataFrame:
    """Per page (tbl, mets_id, page_no) the places of its furniture lines (``furniture``, an array of
    line_ord) and of a section heading in the place of the head (``heading``, a line_ord or null)."""
    full = F.filter("lines", lambda x: F.size(x["words"]) > 0)
    edge = lambda a: F.transform(a, lambda x: F.struct(x["line_ord"].alias("line_ord"), _edge_text(x["words"]).alias("text")))
    pages = pages.filter("lone IS NULL").select("tbl", "mets_id", "block", "page_no", full.alias("full")).filter("size(full) > 0")
    n = F.size("full")
    pages = pages.select(
        "tbl", "mets_id", "block", "page_no", edge(F.slice("full", 1, EDGE_LINES)).alias("top"),
        # The lines from the last one upwards; the first two of the page are none of them.
        F.reverse(edge(F.slice("full", F.greatest(n - EDGE_LINES, F.lit(2)) + 1, F.lit(EDGE_LINES)))).alias("end"),
    )
    cols = {"l1": F.get("top", F.lit(0)), "l2": F.get("top", F.lit(1)), "lz": F.get("end", F.lit(0)), "ly": F.get("end", F.lit(1))}
    pages = pages.withColumns(cols)
    whole = {f"{c}_whole": F.nullif(F.regexp_extract(F.col(f"{c}.text"), _WHOLE, 1), F.lit("")) for c in cols}
    pages = pages.withColumns({**whole, "last": F.nullif(F.regexp_extract("l1.text", _LAST, 2), F.lit("")), "first": F.nullif(F.regexp_extract("l1.text", _FIRST, 1), F.lit(""))})
    pages = _with_numbers(cut(pages))
    # A head stands below a number in the first line, a foot above one in the last.
    below, above = F.when(~F.col("l2_whole_no"), F.col("l2.text")), F.when(~F.col("ly_whole_no"), F.col("ly.text"))
    bare = (
        F.when(F.col("l1_whole_no"), below).when(F.col("last_no"), F.regexp_extract("l1.text", _LAST, 1))
        .when(F.col("first_no"), F.regexp_extract("l1.text", _FIRST, 2)).otherwise(F.col("l1.text"))
    )
    low = lambda x: F.lower(F.trim(x))
    inner = lambda side, skip: F.transform(F.slice(side, F.when(skip, 3).otherwise(2), 2), lambda x: F.struct(x["line_ord"].alias("line_ord"), low(x["text"]).alias("text")))
    pages = pages.withColumns({
        "head": low(bare), "foot": low(F.when(F.col("lz_whole_no"), above).otherwise(F.col("lz.text"))), "inline": F.col("last_no") | F.col("first_no"),
        "head_in": F.col("l1_whole_no"), "foot_in": F.col("lz_whole_no"),
        "head_more": inner("top", F.col("l1_whole_no") | F.col("l2_whole_no")), "foot_more": inner("end", F.col("lz_whole_no") | F.col("ly_whole_no")),
        "top_no": F.col("last_no") | F.col("first_no") | F.col("l1_whole_no") | F.col("l2_whole_no"),
    }).drop("top", "end")

    # The scans around each page: those at a block's border stand in the next block as well.
    reach = [F.floor((F.col("page_no") + d) / BLOCK) for d in (-REACH, 0, REACH)]
    spread = pages.withColumn("at", F.explode(F.array_distinct(F.array(*reach))))
    around = W.partitionBy("tbl", "mets_id", "at").orderBy("page_no").rangeBetween(-REACH, REACH)
    texts = lambda c: F.transform(c, lambda x: x["text"])
    row = F.struct("page_no", "head", "head_in", "foot", "foot_in", texts("head_more").alias("head_more"), texts("foot_more").alias("foot_more"))
    pages = spread.withColumn("around", F.collect_list(row).over(around)).filter("at = block").drop("at")
    other = lambda x: x["page_no"] != F.col("page_no")
    for c in ("head", "foot"):
        like = F.filter("around", lambda x: other(x) & x[c].isNotNull() & _near(F.col(c), x[c]))  # noqa: B023
        pages = pages.withColumn(f"{c}_like", F.transform(like, lambda x: F.struct(x["page_no"].alias("p"), (F.col(f"{c}_in") | x[f"{c}_in"]).alias("i"))))  # noqa: B023
        # Next to a number may stand the text's own line, so what meets it must recur on two scans at least.
        met = lambda cond: F.exists(f"{c}_like", lambda x: cond(x) & (~x["i"] | (F.size(f"{c}_like") >= 2)))  # noqa: B023, E731
        pages = pages.withColumns({f"{c}_before": met(lambda x: x["p"] < F.col("page_no")), f"{c}_after": met(lambda x: x["p"] > F.col("page_no"))})
        outside = F.col(f"{c}_before") | F.col(f"{c}_after") | (F.col("top_no") if c == "head" else F.col("lz_whole_no") | F.col("ly_whole_no"))
        for k in range(2):
            t = F.get(f"{c}_more", F.lit(k))["text"]
            times = F.size(F.filter("around", lambda x: other(x) & _near(t, F.get(x[f"{c}_more"], F.lit(k)))))  # noqa: B023
            pages = pages.withColumn(f"{c}_more_{k}", F.when(outside & _lettered(t), times >= 2).otherwise(F.lit(False)))
            outside = F.col(f"{c}_more_{k}")
    earlier = F.size(F.filter("around", lambda x: (x["page_no"] < F.col("page_no")) & (x["page_no"] >= F.col("page_no") - 2) & x["head"].isNotNull() & ~x["head_in"]))
    pages = cut(pages.withColumn("earlier", F.when(F.col("head").isNotNull(), earlier).otherwise(0)).drop("around", "head_like", "foot_like"))

    side = lambda name, at, text, alone: F.when(alone & _lettered(text), F.struct(F.lit(name).alias("side"), F.lit(str(at)).alias("at"), text.alias("text")))
    listed = []
    for c in ("head", "foot"):
        listed.append(side(c, 0, F.col(c), ~F.col(f"{c}_before") & ~F.col(f"{c}_after")))
        listed += [side(c, k + 1, F.get(f"{c}_more", F.lit(k))["text"], ~F.col(f"{c}_more_{k}")) for k in range(2)]
    usual = pages.groupBy("tbl", "mets_id", "block").agg(F.sum(F.col("top_no").cast("int")).alias("k"), F.count("*").alias("n"))
    usual = cut(usual.groupBy("tbl", "mets_id").agg((F.sum("k") > F.sum("n") * 0.5).alias("top_usual"), F.sum("n").alias("scans")))
    afar = _recurring_afar(pages.select("tbl", "mets_id", "block", "page_no", F.inline(F.array_compact(F.array(*listed)))), usual.select("tbl", "mets_id", "scans"))
    usual = usual.drop("scans")
    pages = _per_work(pages, usual).join(afar, _PAGE, "left")
    far = lambda place: F.coalesce(F.array_contains("afar", place), F.lit(False))

    again = F.col("head_before") | F.col("head_after")
    opens = ~F.col("head_before") & ~F.col("top_no") & (F.col("top_usual") | (F.col("earlier") >= 2))
    afar_head = far("head0") & ~(F.col("top_usual") & ~F.col("top_no"))
    is_head = F.col("inline") | (again & ~opens) | F.col("l2_whole_no") | afar_head
    head = F.when(F.col("l1_whole_no"), again | afar_head).otherwise(is_head)
    foot = F.col("foot_before") | F.col("foot_after") | far("foot0")
    places = [
        F.when(F.col("l1_whole_no") | is_head, F.col("l1.line_ord")), F.when(F.col("l2_whole_no") | (F.col("l1_whole_no") & head), F.col("l2.line_ord")),
        F.when(F.col("ly_whole_no") | (F.col("lz_whole_no") & foot), F.col("ly.line_ord")), F.when(F.col("lz_whole_no") | foot, F.col("lz.line_ord")),
    ]
    for c, outer in (("head", head), ("foot", foot)):
        for k in range(2):
            outer = outer & (F.col(f"{c}_more_{k}") | far(f"{c}{k + 1}"))
            places.append(F.when(outer, F.get(f"{c}_more", F.lit(k))["line_ord"]))
    return pages.select(*_PAGE, F.array_distinct(F.array_compact(F.array(*places))).alias("furniture"), F.when(again & ~is_head, F.col("l1.line_ord")).alias("heading"))


@F.pandas_udf(T.StringType())
def _form(word: pd.Series) -> pd.Series:
    """Comparison form of a word without the marks around it."""
    return pd.Series([None if w is None else _core(word_form(w)) for w in word])


def _core(w: str) -> str:
    a, z = 0, len(w)
    while a < z and not w[a].isalnum():
        a += 1
    while z > a and not w[z - 1].isalnum():
        z -= 1
    return w[a:z]


def _known(lexicon: DataFrame) -> DataFrame:
    """The lexicon's words in comparison form (column ``word_in``)."""
    return lexicon.filter("word IS NOT NULL").select(_form("word").alias("word_in")).distinct()


def _skeleton(x: Column, order: int = 0) -> Column:
    for a, b in CONFUSIONS[order]:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _deletions(x: Column, twice: bool = True) -> Column:
    """Hashes of a skeleton and of what one (from 8 letters on: up to two, if ``twice``) deletions leave of it."""
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    once = F.when(F.length(x) > 1, less(x)).otherwise(F.array(x))
    more = F.when(F.length(x) >= 8, F.flatten(F.transform(once, less))).otherwise(F.array(x)) if twice else F.array(x)
    return F.transform(F.array_distinct(F.concat(F.array(x), once, more)), lambda s: F.xxhash64(s))


def misreadings(counts: DataFrame, known: DataFrame) -> DataFrame:
    """(core, n, better, name) for words outside the lexicon: ``better`` is the word of which ``core``
    is a misreading, else null; ``name`` says that the corpus uses it like a word of its own.

    ``counts`` has (core, n, n_inside), a word's comparison form, its count over the whole corpus and
    that of its places inside a line (at the ends of lines stand parts of broken words), ``known``
    the lexicon's words in comparison form (``word_in``). Numbers are right; digits or signs among letters make a misreading even without a better word.
    """
    known = known.filter("word_in <> ''")
    flagged = counts.withColumn("often", F.col("n_inside") >= NAME_COUNT)
    flagged = meet(flagged, F.col("core"), known.withColumn("in_lexicon", F.lit(True)), "word_in")
    flagged = cut(flagged.withColumn("in_lexicon", F.coalesce("in_lexicon", F.lit(False))))
    number = F.col("core").rlike(r"\A[\p{N}]+(?:[.,:/\-–][\p{N}]+)*(?:st|nd|rd|th|er|e|te|ten|n)?\z") | F.col("core").rlike(r"\A\p{L}{0,2}[²³½¼¾]\z")
    unknown = flagged.filter(~F.col("in_lexicon") & ~number & (F.col("core") != ""))
    goal = flagged.filter("in_lexicon").select("core", "n").unionByName(known.select(F.col("word_in").alias("core"), F.lit(0).cast("bigint").alias("n")))
    goal = goal.groupBy("core").agg(F.max("n").alias("n")).withColumn("lex", F.lit(True))
    goal = goal.unionByName(unknown.filter(F.col("often") & F.col("core").rlike(r"\A[\p{L}\p{M}]+\z")).select("core", "n", F.lit(False).alias("lex")))
    orders = range(len(CONFUSIONS))

    def keys(df: DataFrame, to: str, *more: str) -> DataFrame:
        """The words as ``to`` with their skeletons, once per deletion key; the skeletons are made once a word."""
        df = df.select(F.col("core").alias(to), *[F.col(c).alias(f"{to}_{c}") for c in more], *[_skeleton(F.col("core"), k).alias(f"{to}_s{k}") for k in orders])
        return df.withColumn("key", F.explode(F.array_distinct(F.concat(*[_deletions(F.col(f"{to}_s{k}")) for k in orders]))))

    pairs = keys(unknown, "bad", "n", "often").join(keys(goal, "good", "n", "lex"), "key").drop("key").filter(F.col("bad") != F.col("good")).distinct()
    pairs = pairs.withColumn("apart", F.least(*[F.levenshtein(f"bad_s{k}", f"good_s{k}") for k in orders]))
    d = F.least(F.levenshtein("bad", "good"), F.col("apart") + 1)
    room, apart = F.when(F.length("bad") >= 8, 2).otherwise(1), F.col("apart")
    # A frequent word is a name, unless it is one slip away from a word of the lexicon or far rarer than its model.
    clear = F.col("good_lex") & (~F.col("bad_often") | (apart == 0) | (F.levenshtein("bad", "good") <= 1))
    fits = (clear | (F.col("good_n") >= DOMINANCE * F.col("bad_n"))) & (apart <= room)
    # A short name must not be taken for a word it only shares some letters with.
    fits = fits & ((F.length("bad") >= 3) | (F.levenshtein("bad", "good") <= 1))
    best = pairs.filter(fits).groupBy("bad").agg(F.min(F.struct(d.alias("d"), (-F.col("good_n")).alias("n"), "good")).alias("best"))
    out = unknown.join(best, F.col("core") == F.col("bad"), "left").select("core", "n", "often", F.col("best.good").alias("better"))
    mixed = F.col("core").rlike(r"[\p{N}\p{P}\p{S}&&[^'’\-⸗]]")
    return out.select("core", "n", F.when(F.col("better").isNull() & mixed, F.lit("")).otherwise(F.col("better")).alias("better"),
                      (F.col("better").isNull() & ~mixed & F.col("often")).alias("name"))


class Scans:
    """The steps over one set of page tables; each intermediate table is written once.

    Null, empty and blank texts have no words and belong to no case unless they stand in a furniture
    line. A page of which all lines are blank has no furniture. Lines that share a place are one line,
    in the order of their rows. Rows without a work, page or line can hold misread words only. Empty
    tables give empty results.
    """

    def __init__(self, alto_string: DataFrame, page_line: DataFrame, lexicon: DataFrame):
        self.known = cut(_known(lexicon))
        raw = cut(page_words(alto_string, page_line))
        pages = raw.join(page_furniture(raw), _PAGE, "left")
        # A row without a place meets no page's furniture, since its work, page or line is null.
        marked = F.transform("lines", lambda x: F.struct(
            x["line_ord"].alias("line_ord"), x["ids"].alias("ids"), x["words"].alias("words"),
            F.coalesce(F.col("lone").isNull() & F.array_contains("furniture", x["line_ord"]), F.lit(False)).alias("is_furniture"),
            F.coalesce(F.col("lone").isNull() & (F.col("heading") == x["line_ord"]), F.lit(False)).alias("is_heading"),
        ))
        self.pages = cut(pages.select(*_KEY, marked.alias("lines")))
        self._joins = self._types = None

    def line_ends(self) -> DataFrame:
        """Running lines with their last word and the first words of the next two running lines.

        The second next is kept because the next may be a section heading met only once. Only the last
        line of a page looks for the next page.
        """
        pages = self.pages.filter("lone IS NULL").select(*_PAGE, F.filter("lines", lambda x: ~x["is_furniture"] & ~x["is_heading"] & (F.size(x["words"]) > 0)).alias("run"))
        ends = r"[.,;:!?،؟…]\z|[\p{L}][" + HYPHENS + r"]\z"

        def head(x: Column) -> Column:
            short = (F.size(x["words"]) <= 4) & ~F.element_at(x["words"], -1)["tok"].rlike(ends)
            return F.when(x.isNotNull(), F.struct(x["line_ord"].alias("ord"), F.get(x["words"], F.lit(0))["tok"].alias("tok"), short.alias("short")))

        def line(x: Column, i: Column) -> Column:
            last = F.element_at(x["words"], -1)
            return F.struct(x["line_ord"].alias("line_ord"), last["tok"].alias("a"), last["id"].alias("a_id"), F.size(x["words"]).alias("n_words"),
                            head(F.get("run", i + 1)).alias("b1"), head(F.get("run", i + 2)).alias("b2"))

        lines = pages.select(*_PAGE, F.inline(F.transform("run", line)))
        tops = pages.filter("size(run) > 0").select(
            "tbl", "mets_id", (F.col("page_no") - 1).alias("page_no"), head(F.get("run", F.lit(0))).alias("t1"), head(F.get("run", F.lit(1))).alias("t2"))
        last = lines.filter("b1 IS NULL").drop("b1", "b2").join(tops, _PAGE).withColumns({"b1": F.col("t1"), "b2": F.when(F.col("t1.short"), F.col("t2"))}).drop("t1", "t2")
        inner = lines.filter("b1 IS NOT NULL").withColumn("b2", F.lit(None).cast(lines.schema["b2"].dataType))
        return inner.withColumn("across", F.lit(False)).unionByName(last.withColumn("across", F.lit(True)))

    def joins(self) -> DataFrame:
        """(tbl, mets_id, page_no, line_ord, a_id, n_words, hyphen, rest, next_page, next_ord): lines whose last word goes on with ``rest``."""
        if self._joins is not None:
            return self._joins
        e = self.line_ends()
        hyphen = F.col("a").rlike(rf"[\p{{L}}\p{{M}}][{HYPHENS}]+[\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}\x{{202C}}]*\z")
        open_end = F.col("a").rlike(r"[\p{L}\p{M}\p{Cf}\p{N}]\z")
        e = e.filter(hyphen | open_end).withColumns({"hyphen": hyphen, "fa": _form("a"), "f1": _form("b1.tok"), "f2": _form("b2.tok")})
        e = e.withColumns({"c1": F.concat("fa", "f1"), "c2": F.concat("fa", "f2")})
        # One vocabulary for all questions: is it a word, a name, a conjunction (also a misread one)?
        own = self.types()
        says = lambda df, word, **f: df.select(F.col(word).alias("word"), *[f.get(n, F.lit(False)).alias(n) for n in ("known", "name", "conj")])
        conj = F.col("better").isin(*CONJUNCTIONS)
        vocabulary = says(self.known, "word_in", known=F.lit(True)).unionByName(says(own.filter(F.col("name") | conj), "core", name=F.col("name"), conj=F.coalesce(conj, F.lit(False))))
        vocabulary = cut(vocabulary.groupBy("word").agg(*[F.max(n).alias(n) for n in ("known", "name", "conj")]))
        small = is_small(vocabulary)
        for c in ("fa", "f1", "f2", "c1", "c2"):
            e = meet(e, F.col(c), vocabulary.select("word", F.struct("known", "name", "conj").alias(f"is_{c}")), "word", small=small)
        is_ = lambda c, what: F.coalesce(F.col(f"is_{c}.{what}"), F.lit(False))
        w1, w2 = is_("c1", "known") | is_("c1", "name"), is_("c2", "known") | is_("c2", "name")
        starts = F.col("b1.tok").rlike(r"\A[\p{L}\p{M}\p{Cf}]")
        second = ~w1 & w2 & (F.col("hyphen") | ~(is_("fa", "known") & is_("f2", "known")))
        bare = w1 & ~(is_("fa", "known") & is_("f1", "known")) & starts & (F.length("fa") > 0) & (F.length("f1") > 0)
        rest_of_compound = F.col("f1").isin(*CONJUNCTIONS) | is_("f1", "conj")
        first = F.when(F.col("hyphen"), w1 | (F.length("f1") > 0) & ~rest_of_compound).otherwise(bare)
        out = e.withColumn("b", F.when(second, F.col("b2")).when(first, F.col("b1"))).filter("b IS NOT NULL")
        self._joins = cut(out.select(*_PAGE, "line_ord", "a_id", "n_words", "hyphen", F.col("b.tok").alias("rest"),
                                     (F.col("page_no") + F.col("across").cast("int")).alias("next_page"), F.col("b.ord").alias("next_ord")))
        return self._joins

    def _tokens(self) -> DataFrame:
        """Words of all lines but furniture, with their place in the line."""
        lines = self.pages.select("tbl", "mets_id", "page_no", "lone", F.explode(F.filter("lines", lambda x: ~x["is_furniture"])).alias("l"))
        lines = lines.select(*_PAGE, "lone", F.col("l.line_ord").alias("line_ord"), F.size("l.words").alias("n_words"), F.posexplode("l.words").alias("pos", "w"))
        return lines.select(*_PAGE, "lone", "line_ord", "n_words", "pos", F.col("w.id").alias("id"), F.col("w.tok").alias("tok"))

    def forms(self) -> DataFrame:
        """Distinct words as they stand with their count, that of their places inside a line, and their comparison form."""
        inside = (F.col("pos") > 0) & (F.col("pos") < F.col("n_words") - 1)
        return self._tokens().groupBy("tok").agg(F.count("*").alias("n"), F.sum(inside.cast("int")).alias("n_inside")).withColumn("core", _form("tok"))

    def types(self) -> DataFrame:
        """``misreadings`` over the corpus."""
        if self._types is None:
            self._forms = cut(self.forms())
            counts = self._forms.groupBy("core").agg(F.sum("n").alias("n"), F.sum("n_inside").alias("n_inside"))
            self._types = cut(misreadings(counts, self.known))
        return self._types

    def misread_tokens(self) -> DataFrame:
        """Words with a wrong character that are not broken over two lines, with the better word."""
        bad = self.types().filter("better IS NOT NULL").select("core", "better")
        stems = F.transform(F.sequence(F.lit(2), F.length("word_in")), lambda i: F.substring(F.col("word_in"), F.lit(1), i))
        prefixes = self.known.filter(F.length("word_in") >= 2).select(F.explode(stems).alias("stem")).distinct()
        forms = self._forms.join(bad, "core").filter(F.col("tok").isNotNull())
        # "Land-" before "oder" is the beginning of a word, not a misread one.
        open_ = F.when(F.col("tok").rlike(rf"[{HYPHENS}]\W*\z"), F.col("core"))
        forms = forms.join(prefixes, open_ == F.col("stem"), "left_anti")
        tokens = meet(self._tokens(), F.col("tok"), cut(forms.select(F.col("tok").alias("word"), "better")), "word", "inner")
        j = self.joins()
        ends = j.select(*_PAGE, "line_ord", (F.col("n_words") - 1).alias("pos"))
        starts = j.select("tbl", "mets_id", F.col("next_page").alias("page_no"), F.col("next_ord").alias("line_ord"), F.lit(0).alias("pos"))
        return tokens.join(ends.unionByName(starts), [*_PAGE, "line_ord", "pos"], "left_anti")

    def found(self) -> DataFrame:
        """(tbl, row_id, kind): furniture, joined and misread rows."""
        lines = self.pages.select("tbl", F.explode(F.filter("lines", lambda x: x["is_furniture"])).alias("l"))
        furniture = lines.select("tbl", F.explode("l.ids").alias("row_id"), F.lit("furniture").alias("kind"))
        joined = self.joins().select("tbl", F.col("a_id").alias("row_id"), F.lit("joined").alias("kind"))
        misread = self.misread_tokens().select("tbl", F.col("id").alias("row_id"), F.lit("misread").alias("kind"))
        return furniture.unionByName(joined).unionByName(misread).distinct()

    def paragraphs(self) -> DataFrame:
        """(tbl, mets_id, page_no, para_no, text): the running text of each page in paragraphs.

        A broken word stands whole where it begins, also across pages. A paragraph ends at a line
        that ends a sentence and is clearly shorter than the page's lines, and around a heading.
        What there is to change on a page meets it as one row.
        """
        j = self.joins()
        change = "struct<line_ord:int,pos:int,better:string,rest:string,hyphen:boolean>"
        place = lambda line, pos, better=F.lit(None), rest=F.lit(None), hyphen=F.lit(None): F.struct(
            F.col(line).alias("line_ord"), pos.alias("pos"), better.alias("better"), rest.alias("rest"), hyphen.alias("hyphen")).cast(change).alias("change")
        fixes = self.misread_tokens().filter("better <> '' AND lone IS NULL").select(*_PAGE, place("line_ord", F.col("pos"), better=F.col("better")))
        takes = j.select(*_PAGE, place("line_ord", F.lit(-1), rest=F.col("rest"), hyphen=F.col("hyphen")))
        gives = j.select("tbl", "mets_id", F.col("next_page").alias("page_no"), place("next_ord", F.lit(0)))
        changes = fixes.unionByName(takes).unionByName(gives).groupBy(*_PAGE).agg(F.collect_set("change").alias("changes"))
        pages = self.pages.join(changes, _PAGE, "left").withColumn("changes", F.coalesce("changes", F.array().cast(f"array<{change}>")))

        def text(x: Column) -> Column:
            own = F.filter("changes", lambda c: c["line_ord"] == x["line_ord"])
            better = lambda i: F.get(F.filter(own, lambda c: (c["pos"] == i) & c["better"].isNotNull()), F.lit(0))["better"]
            take = F.get(F.filter(own, lambda c: c["pos"] < 0), F.lit(0))
            toks = F.transform(x["words"], lambda w, i: F.coalesce(_refit(w["tok"], better(i)), w["tok"]))
            gone = F.exists(own, lambda c: (c["pos"] == 0) & c["better"].isNull())
            toks = F.when(gone, F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0)))).otherwise(toks)
            t = F.translate(F.array_join(toks, " "), ZERO_WIDTH, "")
            return F.when(take.isNotNull(), F.concat(F.when(take["hyphen"], F.regexp_replace(t, rf"[{HYPHENS}]+\z", "")).otherwise(t), take["rest"])).otherwise(t)

        run = F.filter("lines", lambda x: ~x["is_furniture"] & (F.size(x["words"]) > 0))
        pages = cut(pages.select(*_PAGE, "lone", F.transform(run, lambda x: F.struct(text(x).alias("text"), x["is_heading"].alias("is_heading"))).alias("run")))
        usual = F.aggregate("run", F.lit(0.0), lambda a, x: a + F.length(x["text"])) / F.nullif(F.size("run"), F.lit(0))
        ends = lambda x: x["is_heading"] | (x["text"].rlike(r"[.!?؟]\W*\z") & (F.length(x["text"]) < 0.8 * F.col("usual")))
        lines = pages.withColumn("usual", usual).select(*_PAGE, "lone", F.posexplode(F.transform("run", lambda x, i: F.struct(
            x["text"].alias("text"), (x["is_heading"] | ((i > 0) & F.coalesce(ends(F.get("run", i - 1)), F.lit(False)))).cast("int").alias("begins")))).alias("at", "l"))
        lines = lines.withColumn("para_no", F.sum("l.begins").over(W.partitionBy(*_PAGE, "lone").orderBy("at")))
        para = lines.filter("l.text <> ''").groupBy(*_PAGE, "lone", "para_no").agg(F.array_sort(F.collect_list(F.struct("at", "l.text"))).alias("ls"))
        return para.select(*_PAGE, "para_no", F.array_join(F.transform("ls", lambda r: r["text"]), " ").alias("text"))


def _refit(old: Column, better: Column) -> Column:
    """``better`` with the marks around the old word and its capital letter."""
    before = F.regexp_extract(old, r"\A[^\p{L}\p{N}]*", 0)
    after = F.regexp_extract(old, r"[^\p{L}\p{N}]*\z", 0)
    capital = old.rlike(r"\A[^\p{L}\p{N}]*\p{Lu}")
    word = F.when(capital, F.concat(F.upper(F.substring(better, 1, 1)), F.substring(better, F.lit(2), F.length(better)))).otherwise(better)
    return F.concat(before, word, after)
