"""Statistics of scores that arrive as a stream.

Counts, sums and moments per key can be merged, so they are kept by a streaming aggregation; medians
and outliers cannot, so the keys that a micro-batch touches are summarised anew from the table of all
scores. Late scores are welcome: without event time there is nothing to drop, and per window they are
taken until the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.statistics import summarise_cleared


def running_moments(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: n_total, n_chars, mean and population standard deviation, for output mode ``update`` or ``complete``."""
    return scores.groupBy(*keys).agg(
        F.count("value").alias("n_total"), F.sum("n_ref").alias("n_chars"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def windowed_moments(scores: DataFrame, keys: list[str], at: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``running_moments`` per time window; scores later than ``late`` behind the newest are dropped."""
    return running_moments(scores.withWatermark(at, late).withColumn("window", F.window(at, width)), ["window", *keys])


def refresh(table: str, result: str, keys: list[str], weighted: bool = False) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds the batch to ``table`` (Parquet) once, and writes the summaries of the
    touched keys as ``result/batch=<id>``; a batch that is tried again replaces its own files."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        everything = spark.read.option("basePath", table).parquet(table).filter(F.col("batch") <= number).drop("batch")
        touched = spark.read.parquet(f"{table}/batch={number}").select(*keys).distinct()
        summarise_cleared(everything.join(touched, keys, "left_semi"), keys, weighted).write.mode("overwrite").parquet(f"{result}/batch={number}")

    return step


def latest(spark, result: str, keys: list[str]) -> DataFrame:
    """The newest summary of each key."""
    rows = spark.read.option("basePath", result).parquet(result)
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"]).drop("batch")
