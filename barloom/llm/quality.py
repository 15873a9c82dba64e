"""Operator 7: a quality classifier as a factorisation machine.

Inputs of a score are structure statistics and metadata of the whole text (its length, bytes a
character, addresses in it), each cut into quantile bins, and hashed words. A factorisation
machine models every pair of features through the product of their low-rank vectors; the
sum-of-squares identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2
makes a score linear in the number of active features, which are kept as (feature, value) lists:
no row is ever as wide as the machine.

Fitting runs on a bounded sample of labelled documents of any length (SAMPLE_EACH rows and
SAMPLE_BUDGET characters of either class), which its settings weren't tuned on; scoring runs over all
whole texts in Arrow batches.

Edge cases: null and empty texts have statistics of 0 and get the score that those have; very
long texts are described whole, in one row of at most 2,048 word features; repeated rows score
alike; words that share a hash bucket count as one; a score of exactly the threshold is predicted
1; without labels of both classes, as in empty tables, every text scores 1 (kept); other columns of
docs are kept and never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

SAMPLE_EACH, SAMPLE_BUDGET = 3_000, 32_000_000
#: Hash buckets of words, bins of each statistic, rank of the interactions.
BUCKETS, BINS, RANK = 2048, 8, 6
STATISTICS = 19
THRESHOLD = 0.3


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure statistics and metadata of a text; all 0 for a text without words."""
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * STATISTICS
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), float, n)
    letters = sum(map(str.isalpha, words))
    plain = sum(w.strip(".,;:!?\"'()-").isalpha() for w in counts)
    odd_ends = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?")
    return [
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        letters / n,
        plain / len(counts),
        odd_ends / n,
        len(counts) / n,
        len(counts) / n**0.8,
        counts.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / n,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        (text.count(".") + text.count("!") + text.count("?")) / n,
        sum(map(text.count, "0123456789")) / chars,
        np.log1p(chars),
        len(text.encode("utf-8", "surrogatepass")) / chars,
        np.log1p(text.count("://") + text.count("@")),
    ]


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def describe(text: str, memory: dict[str, int]) -> tuple[list[float], np.ndarray]:
    """Statistics and the distinct hash buckets of a text's words."""
    words = text.split()
    counts = Counter(words)
    found = []
    for w in counts:
        if (b := memory.get(w)) is None:
            b = memory[w] = bucket(w.lower().strip(".,;:!?\"'()"))
        found.append(b)
    if len(memory) > 200_000:
        memory.clear()
    return statistics(text, words, counts), np.unique(np.array(found, dtype=np.int32))


class Machine:
    """Bin edges and the weights of a fitted factorisation machine."""

    def __init__(self, edges: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.edges, self.size = edges, BUCKETS + edges.shape[0] * BINS
        self.w0, self.w = 0.0, np.zeros(self.size)
        self.v = rng.normal(0, 0.02, (self.size, RANK))

    def row(self, stats: list[float], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and their values: hashed words scaled to a length of 1 together, one bin of each statistic."""
        bins = [BUCKETS + j * BINS + int(np.searchsorted(e, s)) for j, (e, s) in enumerate(zip(self.edges, stats, strict=True))]
        value = np.full(len(words) + len(bins), 0.5)
        value[: len(words)] = 1 / np.sqrt(max(1, len(words)))
        return np.concatenate([words, bins]).astype(np.int64), value

    @staticmethod
    def together(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and values of many rows, and where each row starts."""
        n = np.array([len(f) for f, _ in rows])
        return np.concatenate([f for f, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(n) - n

    def logits(self, feature: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = self.v[feature] * value[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        pairs = (sums**2).sum(1) - np.add.reduceat((scaled**2).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[feature] * value, starts) + pairs / 2, sums

    def scores(self, described: list[tuple[list[float], np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(*self.together([self.row(*d) for d in described]))[0]))


def fit(texts: list[str], y: list[int], epochs: int = 25, batch: int = 128, l2: float = 1e-4, seed: int = 7) -> Machine | None:
    """A machine fitted by Adam on logistic loss, classes weighted alike; None without both classes."""
    labels = np.array(list(y), float)
    if not 0 < labels.sum() < len(labels):
        return None
    memory: dict[str, int] = {}
    described = [describe(t or "", memory) for t in texts]
    stats = np.array([d[0] for d in described])
    edges = np.stack([np.quantile(stats[:, j], np.arange(1, BINS) / BINS) for j in range(stats.shape[1])])
    machine, rng = Machine(edges, seed), np.random.default_rng(seed)
    each = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), machine.w, machine.v)]
    rows, t = [machine.row(*d) for d in described], 0
    for _ in range(epochs):
        order = rng.permutation(len(described))
        for start in range(0, len(order), batch):
            some, t = order[start : start + batch], t + 1
            feature, value, starts = machine.together([rows[i] for i in some])
            z, sums = machine.logits(feature, value, starts)
            g = (1 / (1 + np.exp(-z)) - labels[some]) * each[some] / len(some)
            owner = np.repeat(np.arange(len(some)), np.diff(np.r_[starts, len(feature)]))
            pull = g[owner] * value
            slope = pull[:, None] * (sums[owner] - machine.v[feature] * value[:, None])
            grads = [
                np.array([g.sum()]),
                np.bincount(feature, pull, machine.size) + l2 * machine.w,
                np.stack([np.bincount(feature, slope[:, r], machine.size) for r in range(RANK)], 1) + l2 * machine.v,
            ]
            moves = []
            for grad, m in zip(grads, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.99 * m[1] + 0.01 * grad**2
                moves.append(0.02 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8))
            machine.w0 -= float(moves[0][0])
            machine.w -= moves[1]
            machine.v -= moves[2]
    return machine


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Machine | None:
    """A machine learned from the rows outside the held-out fold."""
    sample = labelled.labelled_sample(docs, labels, "quality", labelled.fold(folds) == held, SAMPLE_EACH, SAMPLE_BUDGET)
    return fit(list(sample["text"]), list(sample["y"]))


def with_score(docs: DataFrame, machine: Machine | None, name: str = "score") -> DataFrame:
    """docs with the quality of each whole text as a further column."""
    if machine is None:
        return docs.withColumn(name, F.lit(1.0))
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict[str, int] = {}
        for texts in batches:
            yield pd.Series(np.concatenate([shared.value.scores([describe(t, memory) for t in texts.iloc[i : i + 200]]) for i in range(0, len(texts), 200)]))

    return docs.withColumn(name, score(common.whole_text()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of the fold crc32 mod 5 = 0 are never learned from."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (labelled.fold(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
