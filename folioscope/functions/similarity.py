"""Similarity of a reference and a candidate, as percentages without rounding.

Measures over characters and token sets are built-in expressions. Only the edit distance of token
sequences, and of characters in long texts, needs Python: it runs bit-parallel on whole integers, a
batch at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx


#: Product of two lengths from which the distance of characters is worked out bit-parallel.
LONG = 1_000_000


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sequence_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def character_similarity(reference: Column, candidate: Column, long: bool = False) -> Column:
    """100 less the edit distance relative to the longer text; two empty texts are equal.

    ``long`` is for texts of pages: pairs whose lengths multiply to ``LONG`` or more leave the built-in
    function, whose time grows with that product, for the bit-parallel one.
    """
    most = F.greatest(F.length(reference), F.length(candidate))
    distance = F.levenshtein(reference, candidate)
    if long:
        big = F.length(reference).cast("bigint") * F.length(candidate) >= LONG
        distance = F.when(big, F.pandas_udf(_distances, T.LongType())(F.when(big, reference), F.when(big, candidate))).otherwise(distance)
    return F.when(most == 0, 100.0).otherwise(100.0 * (1 - distance / most))


def character_distance(reference: Column, candidate: Column) -> Column:
    """The edit distance relative to the longer text, 0 to 1."""
    return 1 - character_similarity(reference, candidate) / 100


def letter_similarity(reference: Column, candidate: Column, long: bool = False) -> Column:
    """``character_similarity`` of letters only."""
    return character_similarity(tx.letters(reference), tx.letters(candidate), long)


def sequence_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences, by bit vectors over ``a``."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for t in b:
        eq = masks.get(t, 0)
        x = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        plus = (down << 1 | ~(x | up)) & full
        minus = up & x
    return score


def _token_distances(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            rows.append((None, None, None, None))
            continue
        r, c = x.split(), y.split()
        odd = Counter(r)
        odd.subtract(c)
        rows.append((sequence_distance(r, c), sum(map(abs, odd.values())), len(r), len(c)))
    return pd.DataFrame(rows, columns=["words", "odd", "n_r", "n_c"], dtype="Int64")


def token_distances(reference: Column, candidate: Column) -> Column:
    """Struct (words, odd, n_r, n_c): edit distance of the token sequences, tokens without a partner, tokens of both texts."""
    return F.pandas_udf(_token_distances, "words long, odd long, n_r long, n_c long")(reference, candidate)


def word_similarity(reference: Column, candidate: Column, distances: Column | None = None) -> Column:
    """100 less the edit distance of the token sequences relative to the longer one."""
    d = token_distances(reference, candidate) if distances is None else distances
    most = F.greatest(d["n_r"], d["n_c"])
    return F.when(most == 0, 100.0).otherwise(100.0 * (1 - d["words"] / most))


def bag_similarity(pairs: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """(key, value, n_ref): 100 less the tokens without a partner relative to all tokens of both texts."""
    side = lambda col, sign: pairs.select(key, F.explode(tx.tokens(F.col(col))).alias("token"), F.lit(sign).alias("sign"))
    per = side(reference, 1).unionByName(side(candidate, -1)).groupBy(key, "token").agg(F.abs(F.sum("sign")).alias("odd"))
    odd = per.groupBy(key).agg(F.sum("odd").alias("odd"))
    r, c = F.size(tx.tokens(F.col(reference))), F.size(tx.tokens(F.col(candidate)))
    both = pairs.select(key, r.alias("n_ref"), (r + c).alias("n"))
    value = F.when(F.col("n") == 0, 100.0).otherwise(100.0 * (1 - F.coalesce("odd", F.lit(0)) / F.col("n")))
    return both.join(odd, key, "left").select(key, value.alias("value"), "n_ref")


def bag_value(reference: Column, candidate: Column, distances: Column | None = None) -> Column:
    """``bag_similarity`` within a row: the tokens of each pair are counted once."""
    d = token_distances(reference, candidate) if distances is None else distances
    n = d["n_r"] + d["n_c"]
    return F.when(n == 0, 100.0).otherwise(100.0 * (1 - d["odd"] / n))


def terms(x: Column, stop: list[str]) -> Column:
    """Distinct tokens that are no stop words."""
    return tx.without(tx.tokens(x), stop)


def term_precision(r: Column, c: Column) -> Column:
    """``precision`` of term sets."""
    return F.when(F.size(c) == 0, 0.0).otherwise(100.0 * F.size(F.array_intersect(r, c)) / F.nullif(F.size(c), F.lit(0)))


def term_recall(r: Column, c: Column) -> Column:
    """``recall`` of term sets."""
    return F.when(F.size(r) > 0, 100.0 * F.size(F.array_intersect(r, c)) / F.nullif(F.size(r), F.lit(0)))


def precision(reference: Column, candidate: Column, stop: list[str]) -> Column:
    """Share of the candidate's distinct terms that the reference has; 0 without terms."""
    return term_precision(terms(reference, stop), terms(candidate, stop))


def recall(reference: Column, candidate: Column, stop: list[str]) -> Column:
    """Share of the reference's distinct terms that the candidate has; null without terms."""
    return term_recall(terms(reference, stop), terms(candidate, stop))


def f_measure(p: Column, r: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where one is missing or both are 0."""
    return F.coalesce(F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))), F.lit(0.0))


def dictionary_similarity(texts: DataFrame, key: str, text: str, check: Callable[[], Callable[[str], int]]) -> DataFrame:
    """(key, value, n_ref) by a spell checker: 100 less its findings relative to the tokens.

    ``check`` makes the client of one partition: a function from a text to the number of findings,
    for example one HTTP session. Findings beyond the number of tokens count as that many.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = check()
        for batch in batches:
            n = [len(t.split()) if t else 0 for t in batch["text"]]
            found = [min(client(t), k) if k else 0 for t, k in zip(batch["text"], n, strict=True)]
            yield pd.DataFrame({key: batch[key], "value": [100.0 * (1 - f / k) if k else 100.0 for f, k in zip(found, n, strict=True)], "n_ref": n})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).alias("text")).mapInPandas(rows, f"{key} {kind}, value double, n_ref long")
