"""Text statistics of documents and the verdict whether a document is running prose.

The statistics of a document come in one pass over its whole text. Gradient-boosted trees are
trained on documents that several simple rules label by a clear majority (weak labels: vocabulary,
signs, digits, lines, length). The share of whole sentences, which is what a verdict is about, has no
vote there; the trees find out by themselves what it tells. The trees' margins are then calibrated to
probabilities on the hand-checked sample, which is used for nothing else; ``quality_report`` tells on
its held-out halves how right they are.

Sampling bounds: about ``TRAIN_ROWS`` documents at most (those with the least hash of their id) and
``CALIBRATION_ROWS`` labelled ones reach the driver, as numbers only. Statistics and verdicts cover
all documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_collect, cut

TRAIN_ROWS = 20_000
CALIBRATION_ROWS = 20_000
LEXICON_ROWS = 500_000

FEATURES = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_ratio", "known_ratio", "mean_line_length",
    "structural_lines", "sentence_share", "repeated_lines", "marks_per_word", "words_per_line", "distinct_ratio",
)

_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ‌⁠\xad’'][^\W\d_]+|[̀-ͯ])*")
_SENTENCE = re.compile(r"(?<=[.!?؟;؛])[\"”“»«)\]]*\s+")
_BREAK = re.compile(r"[⸗=¬\-\xad]\n(?=[^\W\d_])")
#: Marks that may end a line of running text, also behind closing quotation marks.
_ENDS = frozenset(".!?؟;:,؛،…\"”“»«)]")
_MIN_WORDS = 4
#: Characters of a table's cell at most.
CELL = 60


def _plain(text: str) -> str:
    """Long s and small e above as the lexicon spells them; signs without width away."""
    if text.isascii():
        return text
    for a, b in (("ſ", "s"), ("aͤ", "ä"), ("oͤ", "ö"), ("uͤ", "ü"), ("​", ""), ("‍", ""), ("⁠", ""), ("﻿", ""), ("\xad", ""), ("‎", ""), ("‏", "")):
        if a in text:
            text = text.replace(a, b)
    return text


def _is_row(line: str) -> bool:
    """A row of a table, an entry with leader dots: such a line is no part of a sentence. A lone tab
    or gap in a long line makes no row."""
    gaps = line.count("\t") + line.strip().count("   ")
    return gaps > 0 and len(line) < CELL * (gaps + 1) or "...." in line or ". . . ." in line or line.count("|") > 1


def text_statistics(text: str | None, common: frozenset, known: frozenset) -> tuple[float, ...]:
    """The values of ``FEATURES``; a null, empty or blank text has zeros.

    A sentence has four words or more, of which an eighth are common ones and half are in the
    lexicon, and two thirds of its characters are letters. Its characters count for
    ``sentence_share``. Lines are joined before, but for rows of tables.
    """
    if not text or text.isspace():
        return (0.0,) * len(FEATURES)
    text = _plain(text).lower()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    blank = text.count(" ") + text.count("\n") + text.count("\t")
    chars = max(1, len(text) - blank)
    running, rows = [], []
    structural = words = letters = hits = knowns = sentence_chars = 0
    distinct: set[str] = set()
    segments: list[str] = []
    for line in _BREAK.sub("", text).split("\n"):
        if not line or line.isspace():
            continue
        if _is_row(line):
            structural += 1
            rows.append(line)
            if running:
                segments += _SENTENCE.split(" ".join(running))
                running.clear()
        else:
            running.append(line)
    if running:
        segments += _SENTENCE.split(" ".join(running))
    for s, free in [*((s, True) for s in segments), *((r, False) for r in rows)]:
        ws = _WORD.findall(s)
        if not ws:
            continue
        n, size = len(ws), sum(map(len, ws))
        k, c = sum(map(known.__contains__, ws)), sum(map(common.__contains__, ws))
        words, letters, knowns, hits = words + n, letters + size, knowns + k, hits + c
        distinct.update(ws)
        solid = len(s) - s.count(" ")
        if free and n >= _MIN_WORDS and c * 8 >= n and k * 2 >= n and size * 3 >= solid * 2:
            sentence_chars += solid
    digits = sum(map(text.count, "0123456789"))
    return (
        float(words),
        letters / words if words else 0.0,
        max(0, chars - letters - digits) / chars,
        digits / chars,
        sum(1 for x in lines if x.rstrip()[-1] in _ENDS) / len(lines),
        hits / words if words else 0.0,
        knowns / words if words else 0.0,
        len(text) / len(lines),
        structural / len(lines),
        min(1.0, sentence_chars / chars),
        1 - len(set(lines)) / len(lines),
        sum(map(text.count, ";:|,.")) / max(1, words),
        words / len(lines),
        len(distinct) / words if words else 0.0,
    )


def document_statistics(documents: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the columns of ``FEATURES`` in place of the text.

    A statistic that shares its name with a column of the table replaces it. The lexicon is a small
    table of reference; beyond ``LEXICON_ROWS`` distinct words an error says so.
    """
    rows = bounded_collect(lexicon.filter("word IS NOT NULL").groupBy(F.lower("word").alias("w")).agg(F.max("is_common").alias("c")), LEXICON_ROWS, "lexicon")
    known, common = frozenset(_plain(r.w).lower() for r in rows), frozenset(_plain(r.w).lower() for r in rows if r.c)
    kind = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])

    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t, common, known) for t in texts], columns=FEATURES)

    return documents.withColumn("_stats", F.pandas_udf(stats, kind)(F.col(text))).select(
        *[c for c in documents.columns if c != text and c not in FEATURES], *[F.col("_stats")[f].alias(f) for f in FEATURES]
    )


#: Weak rules for prose: a statistic, the value from which it speaks for prose, and its votes.
PROSE_RULES = (("common_ratio", 0.3, 2), ("words_per_line", 5.0, 1), ("words", 20.0, 1))
#: Weak rules for structural junk, from a value on and up to a value. Known words, few digits or few signs say
#: nothing for prose, since lists of words have them as well. ``sentence_share`` has no vote: it is the trees' to use.
JUNK_FROM = (("structural_lines", 0.5, 2), ("digit_ratio", 0.15, 1), ("symbol_ratio", 0.3, 1), ("marks_per_word", 0.6, 1), ("mean_word_length", 8.0, 1))
JUNK_UP_TO = (("common_ratio", 0.15, 2), ("known_ratio", 0.5, 3), ("words_per_line", 2.5, 2), ("words", 4.0, 2))
#: Votes by which one side must lead.
LEAD = 2


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 prose, 0 structural junk, -1 undecided: the side that leads by ``LEAD`` votes or more."""
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    votes = sum(np.where(f[n] >= v, k, 0) for n, v, k in PROSE_RULES)
    votes = votes - sum(np.where(f[n] >= v, k, 0) for n, v, k in JUNK_FROM) - sum(np.where(f[n] <= v, k, 0) for n, v, k in JUNK_UP_TO)
    return np.where(votes >= LEAD, 1, np.where(votes <= -LEAD, 0, -1))


class BoostedTrees:
    """Gradient-boosted regression trees for a yes-no target, on binned values; deterministic."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if not len(y) or y.min() == y.max():
            self.base = 0.0 if not len(y) else (6.0 if y[0] else -6.0)
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), 0)
            self.nodes.append(tree)
            f += self._apply(tree, x)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int):
        gs, hs = g[at].sum(), h[at].sum()
        leaf = self.rate * gs / (hs + 1.0)
        if depth == self.depth or len(at) < 2 * self.least:
            return leaf
        best = (1e-6, None)
        for j, edges in enumerate(self.edges):
            k = len(edges) + 1
            if k < 2:
                continue
            bj = b[at, j]
            gl = np.cumsum(np.bincount(bj, g[at], k))[:-1]
            hl = np.cumsum(np.bincount(bj, h[at], k))[:-1]
            nl = np.cumsum(np.bincount(bj, minlength=k))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < self.least) | (len(at) - nl < self.least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (j, i))
        if best[1] is None:
            return leaf
        j, i = best[1]
        left = b[at, j] <= i
        return (j, float(self.edges[j][i]), self._grow(b, g, h, at[left], depth + 1), self._grow(b, g, h, at[~left], depth + 1))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, edge, left, right = tree
        return np.where(x[:, j] <= edge, self._apply(left, x), self._apply(right, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._apply(t, x) for t in self.nodes), np.zeros(len(x)))


def calibration(margin: np.ndarray, y: np.ndarray, noise: float = 0.01, steps: int = 100) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(-(a * margin + b))), for labels of which a share ``noise`` is wrong.

    A weak pull towards (1, 0) keeps the fit finite where the labels are separable.
    """
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    target = np.where(y > 0, 1 - noise, noise)
    m, ab = np.clip(margin, -20, 20), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(ab[0] * m + ab[1])))
        w, r = p * (1 - p), target - p
        g = np.array([(r * m).sum(), r.sum()]) - (ab - [1, 0])
        h = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        ab = ab + step
        if np.abs(step).max() < 1e-6:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


def _bounded(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most: those with the least hash of their key."""
    n = rows.count()
    return rows.filter(F.xxhash64(F.col(key)) < F.lit(int(-(2**63) + 2**64 * bound / n))) if n > bound else rows


def _numbers(rows: DataFrame, *more: str) -> np.ndarray:
    return rows.select(*FEATURES, *more).toPandas().to_numpy(dtype=float).reshape(-1, len(FEATURES) + len(more))


def trees(stats: DataFrame, key: str = "doc_id") -> BoostedTrees:
    """Trees fitted on the weakly labelled among about ``TRAIN_ROWS`` documents."""
    sample = _numbers(_bounded(stats, key, TRAIN_ROWS))
    weak = weak_labels(sample)
    return BoostedTrees().fit(sample[weak >= 0], weak[weak >= 0].astype(float))


def checked_sample(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Statistics of the hand-checked documents and whether each is prose, in the order of their ids.

    ``labels`` has (doc_id, doc_kind); a document labelled more than once counts with its majority,
    and not at all on a tie. The labels are bounded before they meet the documents.
    """
    prose = F.avg((F.col("doc_kind") == "prose").cast("int"))
    majority = labels.filter("doc_kind IS NOT NULL").groupBy(key).agg(prose.alias("_prose")).filter("_prose <> 0.5")
    rows = _numbers(stats.join(F.broadcast(_bounded(majority, key, CALIBRATION_ROWS)), key).orderBy(key), "_prose")
    return rows[:, :-1], (rows[:, -1] > 0.5).astype(float)


def _probability(margin: np.ndarray, a: float = 1.0, b: float = 0.0) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> Callable[[np.ndarray], np.ndarray]:
    """A function from statistics to the probability of prose. Without usable labels the margins stay uncalibrated."""
    model = trees(stats, key)
    a, b = calibration(model.margin((checked := checked_sample(stats, labels, key))[0]), checked[1])
    return lambda x: _probability(model.margin(x), a, b)


REPORT = "model string, documents long, accuracy double, brier double, probability double, share_prose double"


def quality_report(documents: DataFrame, labels: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """How right the verdicts are on the hand-checked sample (model, documents, accuracy, brier, probability, share_prose).

    Rows ``threshold <statistic>`` give the best threshold of a single statistic, chosen on the sample
    itself; ``trees`` the uncalibrated trees; ``calibrated`` the calibration, each half of the sample
    being judged by the other; ``reliability`` tells for a tenth of the probabilities its mean and the
    share of prose. Errors of the labels count against all of them.
    """
    rows = documents.select(key, "text").filter(F.col(key).isNotNull()).dropDuplicates([key])
    stats = cut(document_statistics(rows, lexicon))
    x, y = checked_sample(stats, labels, key)
    out: list[tuple] = []
    if len(y):
        model = trees(stats, key)
        for j, name in enumerate(FEATURES):
            order = np.argsort(x[:, j], kind="stable")
            last = np.append(np.diff(x[order, j]) > 0, True)
            below = np.cumsum(1 - y[order]) + (y.sum() - np.cumsum(y[order]))  # right if all up to here are no prose
            right = np.append(np.concatenate([below[last], len(y) - below[last]]), max(y.sum(), len(y) - y.sum()))
            out.append((f"threshold {name}", len(y), float(right.max() / len(y)), None, None, None))
        margin, half = model.margin(x), np.arange(len(y)) % 2
        p = np.zeros(len(y))
        for h in (0, 1):
            p[half == h] = _probability(margin[half == h], *calibration(margin[half != h], y[half != h]))
        for name, q in (("trees", _probability(margin)), ("calibrated", p)):
            out.append((name, len(y), float(((q >= 0.5) == (y > 0)).mean()), float(((q - y) ** 2).mean()), None, None))
        tenth = np.minimum((p * 10).astype(int), 9)
        out += [("reliability", int((tenth == t).sum()), None, None, float(p[tenth == t].mean()), float(y[tenth == t].mean())) for t in np.unique(tenth)]
    return stats.sparkSession.createDataFrame(out, REPORT)


def document_quality(documents: DataFrame, labels: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, the statistics, p_prose, verdict) per document; the verdict is prose, list, table or junk.

    Documents that stand again with the same id count once. A blank text is junk. Equal texts get
    equal verdicts.
    """
    rows = documents.select(key, "text").filter(F.col(key).isNotNull()).dropDuplicates([key])
    stats = cut(document_statistics(rows, lexicon))
    predict = train(stats, labels, key)

    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(predict(np.stack([c.to_numpy(dtype=float) for c in cols], axis=1)) if len(cols[0]) else np.zeros(0))

    p = F.pandas_udf(score, T.DoubleType())(*FEATURES)
    other = (
        F.when((F.col("known_ratio") < 0.3) & (F.col("digit_ratio") < 0.3) | (F.col("words") < _MIN_WORDS), "junk")
        .when((F.col("structural_lines") > 0.4) & (F.col("marks_per_word") > 0.3) | (F.col("digit_ratio") > 0.35), "table").otherwise("list")
    )
    return stats.withColumn("p_prose", p).withColumn("verdict", F.when(F.col("p_prose") >= 0.5, "prose").otherwise(other))
