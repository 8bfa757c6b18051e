"""Summaries of scores per key, with a second one that leaves out outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Least population standard deviation (on values of 0 to 100) from which outliers are sought.
SPREAD = 1.0
FENCE_RATIO = 1.5


def weighted_mean(value: str = "value", weight: str = "n_ref") -> Column:
    """Mean by weights; the plain mean where they add up to nothing, 0 without values."""
    w = F.sum(weight)
    return F.coalesce(F.when(w > 0, F.sum(F.col(value) * F.col(weight)) / F.nullif(w, F.lit(0).cast("bigint"))).otherwise(F.avg(value)), F.lit(0.0))


def summarise(scores: DataFrame, keys: list[str], weighted: bool = False, value: str = "value", weight: str = "n_ref") -> DataFrame:
    """Per key: n_total, mean, population standard deviation, median and the sum of the weights."""
    return summarise_cleared(scores, keys, weighted, True, value=value, weight=weight).drop("cleared")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join over keys of which null equals null."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or F.lit(True)
    return left.join(named, on, how).drop(*[f"_{k}" for k in keys])


def ranked_values(scores: DataFrame, keys: list[str], value: str = "value", weight: str = "n_ref") -> DataFrame:
    """(keys, value, n, w, upto): the distinct values of each key with how often they stand there, the sum of
    their weights and the number of values up to and with them; null values have n = 0.

    Values are counted before they are shuffled, sorted over ranges of key and value, and ranked inside
    each range on top of the ranges' totals, so a key that holds a third of all rows is spread as well.
    """
    counts = scores.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count(value).alias("n"), F.sum(weight).alias("w"))
    order = [F.col(k) for k in keys] + [F.col("value")]
    counts = cut(counts.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = F.coalesce(F.sum("t").over(W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy(*keys, "range").agg(F.sum("n").alias("t")).select(*keys, "range", before.alias("before"))
    inside = F.sum("n").over(W.partitionBy(*keys, "range").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return _same(counts.withColumn("inside", inside), totals, [*keys, "range"]).select(*keys, "value", "n", "w", (F.col("inside") + F.col("before")).alias("upto"))


def _at(rank: Column, name: str, *what: str) -> list[Column]:
    """Aggregates: ``<name>_<what>`` of the one row that holds the rank (plain numbers, so no struct has to be sorted)."""
    here = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    return [F.max(F.when(here, F.col(c))).alias(f"{name}_{c}") for c in what or ("value",)]


def _middle(first: Column, n: Column) -> tuple[Column, Column]:
    """The two middle ranks of ``n`` values from the rank ``first`` on."""
    return first + F.floor((n - 1) / 2), first + F.floor(n / 2)


def _pair(low: str, high: str) -> Column:
    """The mean of two picked values; null where there are none."""
    return (F.col(f"{low}_value") + F.col(f"{high}_value")) / 2


def _sums(weighted: bool) -> list[Column]:
    plain = F.sum(F.col("value") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0).cast("bigint"))
    w = F.sum("w")
    mean = F.coalesce(F.when(w > 0, F.sum(F.col("value") * F.col("w")) / F.nullif(w, F.lit(0).cast("bigint"))).otherwise(plain), F.lit(0.0)) if weighted else plain
    return [F.sum("n").alias("n_total"), mean.alias("mean"), plain.alias("plain"), F.coalesce(w, F.lit(0).cast("bigint")).alias("n_chars")]


_CLEARED = "struct<n_total:bigint,mean:double,std:double,median:double,n_chars:bigint>"


def _deviation() -> Column:
    """Aggregate: population standard deviation of the values around ``plain``."""
    return F.sqrt(F.sum(F.col("n") * F.pow(F.col("value") - F.col("plain"), 2)) / F.nullif(F.sum("n"), F.lit(0).cast("bigint")))


def summarise_cleared(
    scores: DataFrame, keys: list[str], weighted: bool = False, strict: bool = False, ratio: float = FENCE_RATIO, value: str = "value", weight: str = "n_ref",
) -> DataFrame:
    """Per key n_total, mean, std (population), median, n_chars (sum of the weights), and the struct
    ``cleared``: the same without outliers.

    Quartiles are the medians of the values strictly below and above the median; where one half is empty
    no value lies between the fences. ``cleared`` is null where outliers are not sought (strict, or a
    standard deviation below ``SPREAD``) and where none were found. If all values fall out it stays,
    with a count of 0 and null statistics (a weighted mean of 0). All of it is worked out from the
    counts of distinct values (``ranked_values``), of which scores of two decimals have 10 001 a key.
    """
    r = cut(ranked_values(scores, keys, value, weight))
    total = r.groupBy(*keys).agg(*_sums(weighted))
    lo, hi = _middle(F.lit(1), F.col("n_total"))
    known = r.filter("n > 0")
    middle = _same(known, total, keys).groupBy(*keys).agg(*_at(lo, "lo", "value", "n", "upto"), *_at(hi, "hi", "value", "n", "upto"), _deviation().alias("std"))
    total = _same(total, middle, keys, "left").withColumn("median", _pair("lo", "hi"))
    out = total.select(*keys, "n_total", "mean", "std", "median", "n_chars")
    if strict:
        return out.withColumn("cleared", F.lit(None).cast(_CLEARED))
    # Ranks strictly below and above the median: its own value belongs to neither half.
    one = F.col("lo_value") == F.col("hi_value")
    below = F.when(one, F.col("lo_upto") - F.col("lo_n")).otherwise(F.col("lo_upto"))
    above = F.col("n_total") - F.when(one, F.col("hi_upto")).otherwise(F.col("hi_upto") - F.col("hi_n"))
    wide = cut(total.filter((F.col("std") >= SPREAD) & (F.col("n_total") > 1)).select(*keys, below.alias("below"), (F.col("n_total") - above + 1).alias("from"), above.alias("above"), "n_total"))
    open_ = _same(known, wide, keys)
    (a, b), (c, d) = _middle(F.lit(1), F.col("below")), _middle(F.col("from"), F.col("above"))
    half = lambda n, rank, name: _at(F.when(F.col(n) > 0, rank), name)
    q = open_.groupBy(*keys).agg(*half("below", a, "a"), *half("below", b, "b"), *half("above", c, "c"), *half("above", d, "d"))
    q = q.select(*keys, _pair("a", "b").alias("q1"), _pair("c", "d").alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * ratio
    kept = _same(known, q.select(*keys, (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")), keys).filter(F.col("value").between(F.col("low"), F.col("high")))
    sums = kept.groupBy(*keys).agg(*_sums(weighted), F.min(F.col("upto") - F.col("n") + 1).alias("first"))
    e, f = _middle(F.col("first"), F.col("n_total"))
    inner = _same(kept, sums.select(*keys, "n_total", "plain", "first"), keys).groupBy(*keys).agg(*_at(e, "e"), *_at(f, "f"), _deviation().alias("std"))
    sums = _same(sums, inner.select(*keys, "std", _pair("e", "f").alias("median")), keys)
    rest = _same(wide.select(*keys), sums, keys, "left").fillna(0, ["n_total", "n_chars"] + (["mean"] if weighted else []))
    cleared = rest.select(*keys, F.struct("n_total", "mean", "std", "median", "n_chars").cast(_CLEARED).alias("cleared"))
    out = _same(out, cleared, keys, "left")
    return out.withColumn("cleared", F.when(F.col("cleared.n_total") < F.col("n_total"), F.col("cleared")))
