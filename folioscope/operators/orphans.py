"""References to records that did not exist when the reference was recorded.

Keys of both sides are dictionary-encoded as integers, clustered by document. Per key range (32 768
codes) and month one bitmap holds the keys referenced; two more hold the keys from which a target
lives through whole months, and those where that ends. Run through the months of a key range, these
give the keys alive throughout, and ``referenced AND NOT alive`` leaves the keys to look at. Only
the rows of those keys are compared with the targets' exact spans, since a target may begin or end
inside the month.

A key that a third of all rows reference is one bit after the map-side part of the aggregation, its
rows meet it again in ``PARTS`` parts, and a key range with all its months is bounded (two 4 KB bitmaps
a month and field), so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

#: Codes of one bitmap; ``bitmap_bucket_number`` counts in these.
RANGE = 32768
#: A bitmap with fewer bits than this is kept as 16-bit positions, which take less room.
SPARSE = RANGE // 16

#: Parts over which the referring rows of one key and month are spread.
PARTS = 8

REFERENCE_COLUMNS = ("ref_table", "ref_field", "scope", "row_key", "target_kind", "target_id", "at")
TARGET_COLUMNS = ("target_kind", "scope", "target_id", "from_at", "to_at")


def references(
    df: DataFrame, table: str, field: str, target_kind: str, scope: str = "mets_id", row_key: str = "row_key",
    at: str = "recorded_at", many: bool = True,
) -> DataFrame:
    """One row per referenced id of ``df.field``; with ``many`` the field holds ids parted by white space.

    Null and blank fields reference nothing. A single id is taken as it stands.
    """
    ids = F.explode(F.split(F.col(field), r"\s+")) if many else F.col(field)
    return (
        df.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(scope).alias("scope"),
                  F.col(row_key).alias("row_key"), F.lit(target_kind).alias("target_kind"), ids.alias("target_id"), F.col(at).alias("at"))
        .filter(F.col("target_id").isNotNull() & (F.trim("target_id") != ""))
    )


def targets(df: DataFrame, target_kind: str, key: str, from_at: str, to_at: str = "deleted_at", scope: str = "mets_id") -> DataFrame:
    """One row per span in which a target lives, ``from_at`` inclusive to ``to_at`` exclusive."""
    return df.select(
        F.lit(target_kind).alias("target_kind"), F.col(scope).alias("scope"), F.col(key).alias("target_id"),
        F.col(from_at).alias("from_at"), F.col(to_at).alias("to_at"),
    ).filter(F.col("from_at").isNotNull() & F.col("target_id").isNotNull() & (F.col("to_at").isNull() | (F.col("from_at") < F.col("to_at"))))


def merged_spans(spans: DataFrame) -> DataFrame:
    """Spans of one target that meet or overlap become one; repeated deliveries fall together."""
    key = ["target_kind", "scope", "target_id"]
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    s = spans.select(*key, F.col("from_at").cast("timestamp_ntz").alias("from_at"), F.coalesce(F.col("to_at").cast("timestamp_ntz"), far).alias("to_at"))
    s = s.groupBy(*key, "from_at").agg(F.max("to_at").alias("to_at"))
    w = W.partitionBy(*key).orderBy("from_at")
    s = s.withColumn("reach", F.max("to_at").over(w.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("island", F.sum(F.when(F.col("reach") >= F.col("from_at"), 0).otherwise(1)).over(w))
    return s.groupBy(*key, "island").agg(F.min("from_at").alias("from_at"), F.max("to_at").alias("to_at")).drop("island")


def _month(ts: Column) -> Column:
    """Months since year 0, as an integer."""
    return F.year(ts) * 12 + F.month(ts) - 1


def _starts_month(ts: Column) -> Column:
    return ts == F.date_trunc("month", ts).cast("timestamp_ntz")


def _packed(bitmap: pd.Series) -> pd.Series:
    """Bitmaps as 16-bit positions where that takes less room (first byte 0), else whole (1)."""

    def one(b: bytes) -> bytes:
        bits = np.frombuffer(b, dtype=np.uint8)
        on = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
        return b"\0" + on.astype("<u2").tobytes() if len(on) < SPARSE else b"\1" + b

    return bitmap.map(one)


def _unpacked(b: bytes) -> np.ndarray:
    """The bits of a packed bitmap, eight to the byte."""
    if b[:1] == b"\1":
        return np.frombuffer(b, dtype=np.uint8, offset=1).copy()
    bits = np.zeros(RANGE, dtype=bool)
    bits[np.frombuffer(b, dtype="<u2", offset=1)] = True
    return np.packbits(bits, bitorder="little")


def bitmaps(df: DataFrame, *by: str) -> DataFrame:
    """Compressed bitmaps of ``code`` per key range and the columns ``by``, built on the map side first."""
    pack = F.pandas_udf(_packed, "binary")
    return (
        df.groupBy(*by, F.bitmap_bucket_number("code").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
        .withColumn("bits", pack("bits"))
    )


def _and_not(refs: pd.DataFrame, lives: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
    """Decoded codes of one key range that are referenced and not alive throughout the month."""
    alive = np.zeros(RANGE // 8, dtype=np.uint8)
    events = sorted(zip(lives["month"], lives["begins"], lives["bits"], strict=True), key=lambda e: (e[0], e[1]))
    out, at = [], 0
    for month, group in refs.sort_values("month").groupby("month"):
        while at < len(events) and events[at][0] <= month:
            _, begins, bits = events[at]
            alive = alive | _unpacked(bits) if begins else alive & ~_unpacked(bits)
            at += 1
        for r in group.itertuples():
            left = np.flatnonzero(np.unpackbits(_unpacked(r.bits) & ~alive, bitorder="little"))
            base = (int(r.bucket) - 1) * RANGE
            out.append(pd.DataFrame({"ref_table": r.ref_table, "ref_field": r.ref_field, "month": int(month), "code": left.astype("int64") + base + 1}))
    return pd.concat(out) if out else pd.DataFrame({"ref_table": [], "ref_field": [], "month": [], "code": []})


def orphan_references(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``refs`` (``REFERENCE_COLUMNS``) with no living target in ``spans`` (``TARGET_COLUMNS``).

    Equal rows come out once; ``ref_month`` (``YYYY-MM``) is added. A row without ``at`` cannot have
    a target living then: it is an orphan with a null month. A null scope matches no target. Empty
    tables are fine on either side.
    """
    key = ["target_kind", "scope", "target_id"]
    # Copies fall together before anything else is shuffled; what is left of a key is its distinct referring rows.
    refs = cut(refs.select(*REFERENCE_COLUMNS).withColumn("at", F.col("at").cast("timestamp_ntz")).distinct())
    undated = refs.filter(F.col("at").isNull() | F.col("scope").isNull())
    refs = refs.filter(F.col("at").isNotNull() & F.col("scope").isNotNull()).withColumn("month", _month(F.col("at")))
    spans = merged_spans(spans.select(*TARGET_COLUMNS).filter(F.col("scope").isNotNull()))

    # Dictionary: one row per key with all that is known of it, sorted by document, so that a key range holds
    # neighbours and few months. A key has few spans (they do not overlap) and one entry per month and field.
    asked = refs.groupBy("ref_table", "ref_field", *key, "month").agg(F.lit(1).alias("one")).select(*key, F.struct("ref_table", "ref_field", "month").alias("ask"), F.lit(None).cast("struct<from_at:timestamp_ntz,to_at:timestamp_ntz>").alias("span"))
    known = asked.unionByName(spans.select(*key, F.lit(None).cast(asked.schema["ask"].dataType).alias("ask"), F.struct("from_at", "to_at").alias("span")))
    keys = known.groupBy(*key).agg(F.collect_list("ask").alias("asks"), F.array_sort(F.collect_list("span")).alias("spans"))
    keys = cut(keys.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("code", F.monotonically_increasing_id() + 1))

    referenced = bitmaps(keys.select("code", F.inline("asks")), "ref_table", "ref_field", "month")
    coded = keys.select("code", F.inline("spans"))
    first = F.when(_starts_month(F.col("from_at")), _month(F.col("from_at"))).otherwise(_month(F.col("from_at")) + 1)
    whole = coded.select("code", first.alias("first"), _month(F.col("to_at")).alias("after")).filter("first < after")
    changes = whole.select("code", F.inline(F.array(
        F.struct(F.col("first").alias("month"), F.lit(True).alias("begins")),
        F.struct(F.col("after").alias("month"), F.lit(False).alias("begins")),
    )))
    lives = bitmaps(changes, "month", "begins")
    left = (
        referenced.groupBy("bucket").cogroup(lives.groupBy("bucket"))
        .applyInPandas(_and_not, "ref_table string, ref_field string, month int, code long")
    )

    # Back to rows; a target that lives for part of the month is compared to the instant. The suspects bring
    # their spans along, and each is spread over the parts of its referring rows: a key that a third of all
    # rows reference meets its rows in PARTS tasks.
    suspects = left.join(keys.select("code", *key, "spans"), "code").select("ref_table", "ref_field", "month", *key, "spans", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    rows = refs.withColumn("part", F.pmod(F.xxhash64("row_key", "at"), F.lit(PARTS)).cast("int")).join(suspects, ["ref_table", "ref_field", "month", *key, "part"])
    alive = F.exists("spans", lambda s: (F.col("at") >= s["from_at"]) & (F.col("at") < s["to_at"]))
    orphans = rows.filter(~alive).select(*REFERENCE_COLUMNS)
    return orphans.unionByName(undated).withColumn("ref_month", F.date_format("at", "yyyy-MM"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field and month."""
    return orphans.groupBy("ref_table", "ref_field", "ref_month").agg(F.count("*").alias("orphans"), F.countDistinct("scope", "target_id").alias("missing_ids"))


def mets_references(files: DataFrame, divs: DataFrame, fptrs: DataFrame) -> DataFrame:
    """References of METS files, file groups, divs and file pointers."""
    return (
        references(files, "mets_file", "file_dmdid", "dmd", row_key="file_id")
        .unionByName(references(files, "mets_file", "grp_dmdid", "dmd", row_key="file_id"))
        .unionByName(references(divs, "mets_div", "dmdid", "dmd", row_key="div_id"))
        .unionByName(references(fptrs, "mets_fptr", "file_id", "file", row_key="div_id", many=False))
    )


def mets_targets(dmds: DataFrame, files: DataFrame) -> DataFrame:
    """The dmdSecs and files that may be referenced."""
    return targets(dmds, "dmd", "dmdid", "received_at").unionByName(targets(files, "file", "file_id", "recorded_at"))
