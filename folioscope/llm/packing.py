"""Texts in containers of a fixed number of tokens, by a grouping genetic algorithm.

A text larger than the container is divided into full pieces and a rest; nothing else is divided.
Items fall by hash into blocks of a bounded number, whatever their source. Each block is solved by
several islands: populations of packings whose genes are whole containers. A crossover injects
well-filled containers of one parent into the other, removes the containers that hold an injected
item, and puts the displaced items back by best fit: into a bin that they all but fill, else into new
bins with the one or two others that fit best beside them. After the first round each island's elite
moves on to the next island of its block, and the best packing of the second round is taken. The least
filled containers of a block (at least one, whose room no packing of the block can use) are packed
anew together with those of other blocks.

All random numbers come from the block's and the island's number, so a task that runs again gives the
same packing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded_collect, cut
from .tokens import VOCABULARY, token_count

#: Items of one block on average.
BLOCK_ITEMS = 2_500
ISLANDS = 2
POPULATION = 5
CROSSOVERS = 60
#: Share of a parent's containers that one crossover injects at most.
INJECTED = 0.12
#: Share of a block's containers, the least filled ones and one at least, that are packed again across blocks.
LOOSE = 0.02
#: Blocks whose loose containers are packed together.
JOINED_BLOCKS = 32
#: Share of the receiver's containers, the least filled ones, that one crossover opens at most.
OPENED = 0.4
#: Container kinds at most; a larger table raises.
MAX_KINDS = 1_000


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: list[int], rooms: list[tuple[int, int]], n_bins: int) -> int:
    """Puts the items of ``order`` into the bin with the least room that takes them, or a new one.

    ``rooms`` is the sorted list of (room, bin), ``bins`` the bin of each item; both are updated.
    """
    for i in order:
        size = sizes[i]
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b, n_bins = capacity, n_bins, n_bins + 1
        bins[i] = b
        if room - size > 0:
            insort(rooms, (room - size, b))
    return n_bins


def best_company(items: list[int], sizes: list[int], room: int) -> list[int]:
    """Places in ``items`` (by falling size) of the one item or the two that leave the least of ``room``."""
    best, left = [], room
    lo, hi = 0, len(items) - 1
    while lo <= hi:
        big = sizes[items[lo]]
        if big > room:
            lo += 1
            continue
        if room - big < left:
            best, left = [lo], room - big
        if lo == hi or not left:
            break
        both = big + sizes[items[hi]]
        if both > room:
            lo += 1
        else:
            if room - both < left:
                best, left = [lo, hi], room - both
            hi -= 1
    return best


def refill(sizes: list[int], order: list[int], capacity: int, bins: list[int], rooms: list[tuple[int, int]], n_bins: int) -> int:
    """``best_fit`` that fills each new bin with the items that fit it best together.

    An item goes to an open bin only if it all but fills it; the rest open new bins, each with the one or
    two others that leave the least room. At the end what is left over goes by plain ``best_fit``.
    """
    tight, left = capacity // 100, []
    for i in order:
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms) and rooms[at][0] - sizes[i] <= tight:
            room, b = rooms.pop(at)
            bins[i] = b
            if room > sizes[i]:
                insort(rooms, (room - sizes[i], b))
        else:
            left.append(i)
    loose = []
    while left:
        i = left[0]
        company = best_company(left[1:], sizes, capacity - sizes[i])
        room = capacity - sizes[i] - sum(sizes[left[1 + c]] for c in company)
        while company and room > tight:  # small items: go on filling
            more = best_company([x for k, x in enumerate(left[1:]) if k not in company], sizes, room)
            if not more:
                break
            kept = [k for k in range(len(left) - 1) if k not in company]
            company = [*company, *(kept[m] for m in more)]
            room = capacity - sizes[i] - sum(sizes[left[1 + c]] for c in company)
        chosen = {0, *(1 + c for c in company)}
        if room <= tight:
            for k in chosen:
                bins[left[k]] = n_bins
            if room:
                insort(rooms, (room, n_bins))
            n_bins += 1
        else:
            loose += [left[k] for k in sorted(chosen)]
        left = [x for k, x in enumerate(left) if k not in chosen]
    return best_fit(sizes, sorted(loose, key=lambda i: -sizes[i]), capacity, bins, rooms, n_bins)


class Packing:
    """Bins of all items with the fill of each bin."""

    def __init__(self, bins: np.ndarray, sizes: np.ndarray, capacity: int):
        used, self.bins = np.unique(bins, return_inverse=True)
        self.fill = np.bincount(self.bins, sizes, len(used)) if len(bins) else np.zeros(0)
        self.fitness = float(((self.fill / capacity) ** 2).mean()) if len(used) else 1.0


def first_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator, spread: float) -> Packing:
    """Best fit in order of falling sizes, each first changed by up to ``spread``."""
    order = np.argsort(-sizes * (1 + spread * rng.random(len(sizes))), kind="stable").tolist()
    bins = [0] * len(sizes)
    best_fit(sizes.tolist(), order, capacity, bins, [], 0)
    return Packing(np.array(bins, dtype=np.int64), sizes, capacity)


def crossover(a: Packing, b: Packing, sizes: np.ndarray, plain: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with some of the better-filled half of ``b``'s bins injected."""
    half = np.argsort(-b.fill, kind="stable")[: max(1, len(b.fill) // 2)]
    chosen = rng.permutation(half)[: max(1, int(len(b.fill) * INJECTED * rng.random()))]
    mask = np.zeros(len(b.fill), dtype=bool)
    mask[chosen] = True
    injected = mask[b.bins]
    hit = np.zeros(len(a.fill), dtype=bool)
    hit[a.bins[injected]] = True
    # The least filled bins of the receiver are opened as well, so that their items find better company.
    loose = np.argsort(a.fill, kind="stable")[: 1 + int(len(a.fill) * OPENED * rng.random())]
    hit[loose[a.fill[loose] < capacity]] = True
    displaced = np.flatnonzero(hit[a.bins] & ~injected)
    bins = a.bins.copy()
    n = len(a.fill)
    renamed = np.cumsum(mask) - 1 + n
    bins[injected] = renamed[b.bins[injected]]
    n += int(mask.sum())
    fill = np.bincount(a.bins, sizes, len(a.fill))
    open_bins = np.flatnonzero(~hit & (fill < capacity))
    rooms = sorted(zip((capacity - fill[open_bins]).astype(np.int64).tolist(), open_bins.tolist(), strict=True))
    also = b.fill[chosen] < capacity
    for c in chosen[also]:
        insort(rooms, (int(capacity - b.fill[c]), int(renamed[c])))
    order = displaced[np.argsort(-sizes[displaced], kind="stable")].tolist()
    out = bins.tolist()
    refill(plain, order, capacity, out, rooms, n)
    return Packing(np.array(out, dtype=np.int64), sizes, capacity)


def evolve(sizes: np.ndarray, capacity: int, seed: list[int], elites: list[np.ndarray]) -> Packing:
    """The best packing of an island's population after its crossovers.

    A population starts with best fit by falling sizes. It ends as soon as no packing can have fewer bins.
    """
    rng = np.random.default_rng(seed)
    plain, least = sizes.tolist(), -(-int(sizes.sum()) // capacity)
    group = [Packing(e, sizes, capacity) for e in elites] or [first_packing(sizes, capacity, rng, 0.0)]
    best = max(group, key=lambda p: p.fitness)
    if len(best.fill) <= least:
        return best
    while len(group) < POPULATION:
        group.append(first_packing(sizes, capacity, rng, 0.05 + 0.3 * rng.random()))
    for _ in range(CROSSOVERS):
        i, j = rng.choice(len(group), 2, replace=False)
        a, b = (group[i], group[j]) if group[i].fitness >= group[j].fitness else (group[j], group[i])
        child = crossover(a, b, sizes, plain, capacity, rng)
        worst = min(range(len(group)), key=lambda k: group[k].fitness)
        if child.fitness > group[worst].fitness:
            group[worst] = child
        if len(child.fill) <= least:
            break
    return max(group, key=lambda p: p.fitness)


_KEYS = ["container_kind", "capacity", "block", "island", "doc_id", "piece", "tokens"]
_ROUND_1 = "container_kind string, capacity long, block long, island int, doc_id long, piece long, tokens long, bin long"


def _first_round(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece"], ignore_index=True)
    capacity, block, island = int(rows["capacity"][0]), int(rows["block"][0]), int(rows["island"][0])
    best = evolve(rows["tokens"].to_numpy(dtype=np.int64), capacity, [capacity, block, island, 1], [])
    return rows[_KEYS].assign(bin=best.bins)


def _second_round(rows: pd.DataFrame) -> pd.DataFrame:
    """``origin`` is the island that a packing comes from, ``island`` the one that goes on with it."""
    rows = rows.sort_values(["origin", "doc_id", "piece"], ignore_index=True)
    capacity, block, island = int(rows["capacity"][0]), int(rows["block"][0]), int(rows["island"][0])
    elites = [g["bin"].to_numpy(dtype=np.int64) for _, g in rows.groupby("origin")]
    own = rows[rows["origin"] == rows["origin"][0]].reset_index(drop=True)
    best = evolve(own["tokens"].to_numpy(dtype=np.int64), capacity, [capacity, block, island, 2], elites)
    loose = np.zeros(len(best.fill), dtype=bool)
    loose[np.argsort(best.fill, kind="stable")[: max(1, int(len(best.fill) * LOOSE))]] = True
    loose &= best.fill < capacity
    return own[_KEYS].assign(bin=best.bins, fitness=best.fitness, loose=loose[best.bins])


def _across_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """The loose containers of some blocks, packed anew; the packing they come with is the first elite."""
    rows = rows.sort_values(["block", "bin", "doc_id", "piece"], ignore_index=True)
    capacity, joined = int(rows["capacity"][0]), int(rows["joined"][0])
    own = rows.groupby(["block", "bin"]).ngroup().to_numpy(dtype=np.int64)
    best = evolve(rows["tokens"].to_numpy(dtype=np.int64), capacity, [capacity, joined, 3], [own])
    return rows[["container_kind", "doc_id", "piece", "tokens", "capacity", "joined"]].assign(bin=best.bins)


def sized_texts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens), one row per id."""
    rows = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return rows.select("doc_id", token_count("text", vocabulary).alias("tokens"))


def pack(sizes: DataFrame, kinds: DataFrame, islands: int = ISLANDS) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, token_start, tokens) for every item and kind.

    ``sizes`` has (doc_id, tokens), ``kinds`` (container_kind, capacity_tokens). A text of no tokens
    takes a place without room. A kind that stands again counts once; one without capacity is left
    out. Every token of every text is in exactly one container of each kind. More kinds than
    ``MAX_KINDS`` raise.
    """
    sizes = cut(sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens")))
    kinds = kinds.filter("container_kind IS NOT NULL AND capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    # Each text meets the few kinds through an array in the row, not through a product of tables.
    listed = F.array(*[F.struct(F.lit(r["container_kind"]).alias("container_kind"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in bounded_collect(kinds, MAX_KINDS, "container_kind")])
    items = sizes.select("doc_id", F.col("tokens").alias("all"), F.inline(listed))
    whole = F.floor(F.col("all") / F.col("capacity"))
    full = F.when(whole * F.col("capacity") == F.col("all"), F.greatest(whole - 1, F.lit(0))).otherwise(whole)
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), full)))
    items = items.withColumn("tokens", F.least("capacity", F.col("all") - F.col("piece") * F.col("capacity")))
    filling = F.col("tokens") == F.col("capacity")
    alone = items.filter(filling).select(
        "container_kind", F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "tokens", "capacity"
    )
    n = sizes.count()
    blocks = max(1, round(n / BLOCK_ITEMS))
    rest = items.filter(~filling).withColumn("block", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(blocks)))
    rest = rest.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).select(*_KEYS)
    group = ["container_kind", "capacity", "block", "island"]
    first = rest.groupBy(*group).applyInPandas(_first_round, _ROUND_1)
    onward = F.array_distinct(F.array(F.col("origin"), F.pmod(F.col("origin") + 1, F.lit(islands))))
    moved = first.withColumnRenamed("island", "origin").withColumn("island", F.explode(onward))
    second = moved.groupBy(*group).applyInPandas(_second_round, _ROUND_1 + ", fitness double, loose boolean")
    top = F.max(F.struct("fitness", (-F.col("island")).alias("i"))).over(W.partitionBy("container_kind", "capacity", "block"))
    best = second.withColumn("top", top).filter("island = -top.i")
    name = lambda *parts: F.concat_ws("-", "container_kind", *parts).alias("container_id")
    if blocks > 1:
        best = cut(best)
        joined = best.filter("loose").withColumn("joined", F.floor(F.col("block") / JOINED_BLOCKS)).select("container_kind", "capacity", "joined", "block", "bin", "doc_id", "piece", "tokens")
        schema = "container_kind string, doc_id long, piece long, tokens long, capacity long, joined long, bin long"
        again = joined.groupBy("container_kind", "capacity", "joined").applyInPandas(_across_blocks, schema)
        alone = alone.unionByName(again.select("container_kind", name(F.lit("joined"), "joined", "bin"), "doc_id", "piece", "tokens", "capacity"))
        best = best.filter("NOT loose")
    shared = best.select("container_kind", name("block", "bin"), "doc_id", "piece", "tokens", "capacity")
    out = alone.unionByName(shared)
    return out.select("container_kind", "container_id", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), "tokens")


def _best_fit_only(rows: pd.DataFrame) -> pd.DataFrame:
    capacity = int(rows["capacity"].iloc[0])
    packed = first_packing(rows["tokens"].to_numpy(dtype=np.int64), capacity, np.random.default_rng(0), 0.0)
    return pd.DataFrame({"container_kind": [rows["container_kind"].iloc[0]], "bins": [len(packed.fill)]})


def fill_report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, share of the room in use, the least possible number of containers, and
    the number that best fit by falling size alone needs (in blocks of the same number of items)."""
    packed = cut(packed)
    k = kinds.groupBy("container_kind").agg(F.max("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    c = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t")).groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    blocks = max(1, round(packed.filter("piece = 0").select("doc_id").distinct().count() / BLOCK_ITEMS))
    items = packed.join(F.broadcast(k), "container_kind").select("container_kind", F.col("capacity_tokens").alias("capacity"), "tokens", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(blocks)).alias("block"))
    full = items.filter("tokens = capacity").groupBy("container_kind").agg(F.count("*").alias("bins"))
    plain = items.filter("tokens < capacity").groupBy("container_kind", "capacity", "block").applyInPandas(_best_fit_only, "container_kind string, bins long")
    plain = full.unionByName(plain).groupBy("container_kind").agg(F.sum("bins").alias("best_fit_containers"))
    return c.join(k, "container_kind").join(plain, "container_kind").withColumns({
        "fill": F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")),
        "least_containers": F.ceil(F.col("tokens") / F.col("capacity_tokens")),
    })


RULES = ("overfull containers", "texts with other tokens", "texts with gaps", "small texts divided")


def violations(packed: DataFrame, sizes: DataFrame, kinds: DataFrame) -> DataFrame:
    """(container_kind, rule, n): how often a packing breaks a rule, and the number of its texts (rule ``texts``)."""
    packed = cut(packed)
    k = kinds.groupBy("container_kind").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    fill = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t")).join(F.broadcast(k), "container_kind").groupBy("container_kind").agg(n(F.col("t") > F.col("capacity")).alias(RULES[0]))
    per = packed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"), F.max("piece").alias("last"), F.sum("token_start").alias("starts"))
    per = per.join(sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("own")), "doc_id").join(F.broadcast(k), "container_kind")
    whole = (F.col("last") + 1 == F.col("pieces")) & (F.col("starts") == F.col("capacity") * F.col("last") * (F.col("last") + 1) / 2)
    texts = per.groupBy("container_kind").agg(
        n(F.col("t") != F.col("own")).alias(RULES[1]), n(~whole).alias(RULES[2]), n((F.col("own") <= F.col("capacity")) & (F.col("pieces") > 1)).alias(RULES[3]), F.count("*").alias("texts"))
    both = fill.join(texts, "container_kind")
    return both.select("container_kind", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").cast("bigint").alias("n")) for r in (*RULES, "texts")])))
