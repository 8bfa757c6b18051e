"""Joins of texts' words with a vocabulary that neither gather a frequent word nor broadcast without a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Words that are shipped to every task at most; a larger vocabulary is joined by shuffle.
BROADCAST_WORDS = 200_000
#: A word that makes up more than this part of all is frequent: there are at most as many of them as the number says.
FREQUENT = 10_000


def is_small(words: DataFrame) -> bool:
    """Whether a vocabulary has at most ``BROADCAST_WORDS`` rows."""
    return words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS


def meet(df: DataFrame, on: Column, words: DataFrame, key: str, how: str = "left", small: bool | None = None) -> DataFrame:
    """``df`` joined with ``words`` (one row per ``key``, which goes) where the expression ``on`` is the key.

    Up to ``BROADCAST_WORDS`` words are sent to every task (``small`` tells if that has been checked).
    Of more, the frequent ones (of which there are ``FREQUENT`` at most, whatever the size of ``df``) are
    sent, and only rows with other words are shuffled by their word.
    """
    w = words.withColumnRenamed(key, "_w")
    if is_small(w) if small is None else small:
        return df.join(F.broadcast(w), on == F.col("_w"), how).drop("_w")
    df = df.withColumn("_on", on)
    counts = df.groupBy("_on").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    often = cut(counts.filter((F.col("_n") > total / FREQUENT) & F.col("_on").isNotNull()).select("_on"))
    hot, cold = df.join(F.broadcast(often), "_on", "left_semi"), df.join(F.broadcast(often), "_on", "left_anti")
    hot_words = w.join(F.broadcast(often), F.col("_w") == F.col("_on"), "left_semi")
    hot = hot.join(F.broadcast(hot_words), F.col("_on") == F.col("_w"), how)
    return hot.unionByName(cold.join(w, F.col("_on") == F.col("_w"), how)).drop("_w", "_on")
