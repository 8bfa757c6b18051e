"""A mixture of sources whose shares of the tokens meet target weights.

Weighted fair queueing: in a shuffled order each record of a source has the virtual finish time
``tokens of the source up to and with it / target weight``. A record's further copies follow after
the whole source. All records sorted by that time, up to the budget, give each source its share of
any length of the mixture, so the result is also well mixed locally.

The running totals do not gather a source in one task: records fall by their hash into buckets of a
bounded size, the buckets' totals are summed up, and only inside a bucket records are counted one by
one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded_collect, cut
from .tokens import VOCABULARY, token_count

#: Records of one source that one bucket holds on average at most.
BUCKET_ROWS = 20_000
#: Sources in the table of targets at most.
MAX_SOURCES = 10_000


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), one row per id."""
    rows = documents.select("doc_id", "source", "text").filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return rows.select("doc_id", "source", token_count("text", vocabulary).alias("tokens"))


class Mixture:
    """A mixture of ``documents`` (doc_id, source, tokens) by ``targets`` (source, target_share, max_repeats).

    Records without a source, of sources without a target and without tokens stay out. Shares are
    taken relative to their sum over the sources that have tokens; the others are reported with
    nothing reached and the reason. ``budget_tokens`` is the size of the whole mixture: where a source
    runs out of its repeats the others fill its place by their weights, until all have run out. Without
    it the size is that, of the points where a source runs out, at which the shares are expected to come
    nearest to the targets: a larger mixture leaves scarce sources behind, a smaller one is coarser, as a
    record is never divided. ``feasible`` is the largest size at which every source can give its share.
    The mixture ends at the last record that fits, so each source stays less than one record below its
    part. Ties of the finish time fall by source, copy and id.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, budget_tokens: float | None = None, seed: int = 7):
        wanted = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
        rows = bounded_collect(wanted.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")), MAX_SOURCES, "the table of targets")
        self.targets = targets
        names = [r["source"] for r in rows]
        docs = documents.filter(F.col("source").isin(names) & (F.col("tokens") > 0)) if names else documents.limit(0)
        self.docs = cut(docs.select("doc_id", "source", "tokens", F.xxhash64(F.lit(seed), "doc_id").alias("draw")))
        square = F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("q")
        counts = self.docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), square).collect()
        have = {r["source"]: (r["n"], r["t"]) for r in counts}
        self.grain = {r["source"]: r["q"] / r["t"] for r in counts}
        total = sum(r["share"] for r in rows if r["source"] in have) or 1.0
        self.weights = {r["source"]: r["share"] / total for r in rows if r["source"] in have}
        self.repeats = {r["source"]: r["repeats"] for r in rows if r["source"] in have}
        self.sizes = {s: t for s, (n, t) in have.items()}
        self.feasible = min((self.repeats[s] * self.sizes[s] / w for s, w in self.weights.items()), default=0.0)
        #: Virtual time at which the mixture ends, and the tokens it holds then (but for the last records).
        self.ends = self._nearest() if budget_tokens is None else self._time_of(float(budget_tokens))
        self.budget = self._given(self.ends)
        most = max((n for n, _ in have.values()), default=1)
        self.bits = max(0, math.ceil(math.log2(max(1, most / BUCKET_ROWS))))

    def _given(self, time: float) -> float:
        """Tokens that all sources have given at a virtual time."""
        return sum(min(w * time, self.repeats[s] * self.sizes[s]) for s, w in self.weights.items())

    def _time_of(self, tokens: float) -> float:
        """The virtual time at which so many tokens have been given: between the points where sources run
        out (one a source) their sum rises evenly. Beyond the last of them it is that point."""
        before = 0.0
        for after in sorted(self.repeats[s] * self.sizes[s] / w for s, w in self.weights.items()):
            low, high = self._given(before), self._given(after)
            if tokens <= high:
                return before + (after - before) * max(0.0, tokens - low) / (high - low) if high > low else after
            before = after
        return before

    def _nearest(self) -> float:
        """The time, of those at which a source runs out, with the least expected distance to the targets."""

        def distance(v: float) -> float:
            got = {s: min(w * v, self.repeats[s] * self.sizes[s]) for s, w in self.weights.items()}
            total = sum(got.values())
            return sum(abs(got[s] / total - w) + self.grain[s] / total for s, w in self.weights.items()) / 2

        return min((self.repeats[s] * self.sizes[s] / w for s, w in self.weights.items()), key=lambda v: (distance(v), v), default=0.0)

    def _constants(self) -> DataFrame:
        spark = self.docs.sparkSession
        rows = [(s, float(w), int(self.repeats[s]), int(self.sizes[s])) for s, w in self.weights.items()]
        return F.broadcast(spark.createDataFrame(rows, "source string, weight double, repeats int, source_tokens long"))

    def queued(self) -> DataFrame:
        """(doc_id, source, copy, tokens, finish) of all copies within the budget, not yet sorted."""
        # The upper bits with their sign: buckets in order hold the draws in order, however many there are.
        bucket = F.shiftright(F.col("draw"), 64 - self.bits) if self.bits else F.lit(0).cast("bigint")
        docs = self.docs.withColumn("bucket", bucket)
        totals = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
        before = F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        totals = totals.select("source", "bucket", before.alias("before"))
        inside = F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, 0))
        docs = docs.withColumn("inside", inside).join(totals, ["source", "bucket"]).join(self._constants(), "source")
        upto = F.col("before") + F.col("inside")
        # A hair of tolerance: at the feasible budget the last record of the scarcest source ends exactly on it.
        copies = F.floor((self.ends * (1 + 1e-12) * F.col("weight") - upto) / F.col("source_tokens")) + 1
        copies = F.least(F.greatest(copies, F.lit(0)), F.col("repeats")).cast("int")
        docs = docs.withColumns({"upto": upto, "copies": copies}).filter("copies > 0")
        docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        return docs.select("doc_id", "source", "copy", "tokens", ((F.col("upto") + F.col("copy") * F.col("source_tokens")) / F.col("weight")).alias("finish"))

    def rows(self) -> DataFrame:
        """``queued`` in the order of the mixture, sorted over ranges of the finish time."""
        order = ["finish", "source", "copy", "doc_id"]
        return self.queued().repartitionByRange(*order).sortWithinPartitions(*order)

    def shares(self) -> DataFrame:
        """Per source of the targets: target and actual share, tokens, records, most copies of one, the tokens
        that its repeats could give, and the ``reason`` of a share that was missed: ``no tokens``, ``ran out``,
        ``too coarse`` (the next record would not fit), else null (within half a point of its weight)."""
        got = cut(self.queued().groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), (F.max("copy") + 1).alias("most_copies")))
        total = got.agg(F.sum("tokens")).first()[0] or 0
        t = self.targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(got, "source", "left")
        t = t.join(self._constants().select("source", "weight", "source_tokens"), "source", "left")
        t = t.fillna(0, ["tokens", "records", "most_copies", "source_tokens"])
        could = F.col("max_repeats") * F.col("source_tokens")
        share = F.col("tokens") / total if total else F.lit(0.0)
        reason = (
            F.when(F.col("source_tokens") == 0, "no tokens").when((could <= F.col("weight") * self.ends) & (F.col("weight") - share > 0.005), "ran out")
            .when(F.col("weight") - share > 0.005, "too coarse")
        )
        return t.select("source", "target_share", "max_repeats", "tokens", "records", "most_copies", could.alias("available_tokens"), share.alias("actual_share"), reason.alias("reason"))


    def violations(self) -> DataFrame:
        """(rule, n): records used too often, used twice as the same copy, without their earlier copies, or of no target source."""
        rows = cut(self.queued())
        targets = self.targets.groupBy("source").agg(F.max("max_repeats").alias("most"))
        n = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        per = rows.groupBy("doc_id", "source").agg(F.count("*").alias("k"), F.count_distinct("copy").alias("copies"), F.max("copy").alias("last"))
        known = per.join(F.broadcast(targets), "source", "left")
        return (
            n(known.filter("k > most"), "used too often").unionByName(n(per.filter("k <> copies"), "same copy twice"))
            .unionByName(n(per.filter("last + 1 <> copies"), "earlier copy missing")).unionByName(n(known.filter("most IS NULL"), "no target source"))
        )


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, **options) -> Mixture:
    """The mixture of whole texts sized by the tokenizer."""
    return Mixture(sized_documents(documents, vocabulary), targets, **options)
