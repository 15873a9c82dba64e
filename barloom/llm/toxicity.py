"""Operator 4: toxicity by multiple-instance learning with a noisy-or over sentences.

A sentence's evidence is a sum of non-negative weights of the words and word beginnings that
occur in it; its probability is the logistic value of bias + evidence above that of the bias
alone. A document's probability is the noisy-or of its sentences, so document labels train
sentence scores, and the sentence scores locate what offends.

Fitting runs on a bounded sample of labelled documents of any length (SAMPLE_EACH rows and
SAMPLE_BUDGET characters of either class). Its settings were chosen on a split of the rows that may
be learned from. Scoring runs over all whole texts in Arrow batches, and gives the offending
sentences beside the score.

Edge cases: null, empty and wordless texts score 0; very long texts are scored whole, sentence by
sentence; repeated rows score alike; of features that rank alike the first by name counts; a score of
exactly the threshold is predicted toxic; without labels of both classes, as in empty tables,
every text scores 0; other columns of docs are kept and never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

SAMPLE_EACH, SAMPLE_BUDGET = 3_000, 32_000_000
#: Lengths of word beginnings that serve as features beside whole words.
BEGINNINGS = (3, 4, 5, 6)
BIAS = -4.0
THRESHOLD = 0.7

SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, marked so that they can't be taken for words."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def family(words: list[str]) -> int:
    """The smallest hash of the five-word shingles: most near copies share it."""
    return min((hash_of(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def fit(texts: list[str], y: list[int], keep: int = 4096, min_docs: int = 4, l1: float = 5e-5, steps: int = 400) -> dict[str, float]:
    """Weights of the features that speak for label 1; empty without labels of both classes.

    Candidates are features whose document frequency in class 1 exceeds what chance gives,
    counted once per family of near copies; Adam with an L1 penalty on weights of at least 0.
    """
    seen: set[tuple[int, int]] = set()
    docs: list[tuple[str, int]] = []
    for text, label in zip(texts, y, strict=True):
        lowered = (text or "").lower()
        if (key := (family(WORD.findall(lowered)), label)) not in seen:
            seen.add(key)
            docs.append((lowered, label))
    n, n_pos = len(docs), sum(label for _, label in docs)
    if not 0 < n_pos < n:
        return {}

    def document_frequency(label: int, among: dict[str, int] | None = None) -> dict[str, int]:
        counts: Counter[str] = Counter()
        for text, own in docs:
            if own == label:
                found = {f for w in set(WORD.findall(text)) for f in features_of(w)}
                counts.update(found if among is None else found & among.keys())
        return counts

    in_pos = {f: c for f, c in document_frequency(1).items() if c >= min_docs}
    in_neg = document_frequency(0, in_pos)
    share = n_pos / n

    def z(f: str) -> float:
        c = in_pos[f] + in_neg.get(f, 0)
        return (in_pos[f] - c * share) / math.sqrt(c * share * (1 - share))

    ranked = sorted(((z(f), f) for f in in_pos), key=lambda x: (-x[0], x[1]))
    vocabulary = {f: i for i, (v, f) in enumerate(ranked[:keep]) if v > 3}
    if not vocabulary:
        return {}
    feature, sentence, owner = [], [], []
    for d, (text, _) in enumerate(docs):
        for s in SENTENCE.split(text):
            if hits := [vocabulary[f] for f in {f for w in set(WORD.findall(s)) for f in features_of(w)} if f in vocabulary]:
                feature += hits
                sentence += [len(owner)] * len(hits)
                owner.append(d)
    feature, sentence, owner = np.array(feature, int), np.array(sentence, int), np.array(owner, int)
    label = np.array([label for _, label in docs], float)
    each = np.where(label > 0, 0.5 / n_pos, 0.5 / (n - n_pos))
    w, m, v = np.full(len(vocabulary), 0.5), np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    base = np.log1p(np.exp(BIAS))
    for t in range(1, steps + 1):
        s = BIAS + np.bincount(sentence, w[feature], len(owner))
        none = -np.bincount(owner, np.logaddexp(0, s) - base, n)
        at_none = np.where(label > 0, np.exp(none) / np.maximum(-np.expm1(none), 1e-3), -1.0) * each
        slope = -at_none[owner] / (1 + np.exp(-s))
        g = np.bincount(feature, slope[sentence], len(w)) + l1
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = np.maximum(0, w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8))
    return {f: round(float(w[i]), 6) for f, i in vocabulary.items() if w[i] > 0.02}


class Scorer:
    """Scores texts; remembers the evidence of words it has met, up to a bound."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.met = weights, {}

    def evidence(self, word: str) -> frozenset:
        if (found := self.met.get(word)) is None:
            if len(self.met) > 200_000:
                self.met.clear()
            found = self.met[word] = frozenset(f for f in features_of(word) if f in self.weights)
        return found

    def sentences(self, text: str) -> list[tuple[int, float]]:
        """Number and probability of the sentences that hold any evidence."""
        floor, out = 1 / (1 + math.exp(-BIAS)), []
        lowered = text.lower()
        if not any(map(self.evidence, set(WORD.findall(lowered)))):
            return out
        for i, s in enumerate(SENTENCE.split(lowered)):
            held = frozenset().union(*map(self.evidence, WORD.findall(s)))
            if held:
                p = 1 / (1 + math.exp(-(BIAS + math.fsum(self.weights[f] for f in held))))
                out.append((i, (p - floor) / (1 - floor)))
        return out

    def score(self, text: str) -> float:
        return 1 - math.prod(1 - p for _, p in self.sentences(text))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> dict[str, float]:
    """Weights learned from the rows outside the held-out fold."""
    sample = labelled.labelled_sample(docs, labels, "toxic", labelled.fold(folds) == held, SAMPLE_EACH, SAMPLE_BUDGET)
    return fit(list(sample["text"]), list(sample["y"]))


FOUND = "array<struct<sentence_no:int,sentence:string,probability:double>>"


def with_score(docs: DataFrame, weights: dict[str, float], name: str = "score", least: float = 0.5) -> DataFrame:
    """docs with a further column: struct of the score of each whole text and its offending sentences.

    These are the sentences of a probability of at least `least`, with their number.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            scores, found = [], []
            for text in texts:
                held = scorer.sentences(text)
                scores.append(1 - math.prod(1 - p for _, p in held))
                parts = SENTENCE.split(text) if any(p >= least for _, p in held) else []
                found.append([{"sentence_no": i, "sentence": parts[i].strip(), "probability": p} for i, p in held if p >= least])
            yield pd.DataFrame({"score": scores, "offending": found})

    return docs.withColumn(name, F.pandas_udf(judged, f"struct<score:double,offending:{FOUND}>")(common.whole_text()))


def offending_sentences(docs: DataFrame, weights: dict[str, float], least: float = 0.5) -> DataFrame:
    """doc_id, sentence_no, sentence, probability of every sentence of at least that probability."""
    found = with_score(docs.select("doc_id", "text"), weights, "__judged", least)
    return found.select("doc_id", F.explode("__judged.offending").alias("f")).select("doc_id", "f.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of the fold crc32 mod 3 = 1 are never learned from."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, common.table(spark, sf_dir, "labels")), "judged")
    score = F.col("judged.score")
    return scored.select("doc_id", (labelled.fold(3) == 1).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.col("judged.offending").alias("offending"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold."""
    weights = train(docs, common.table(spark, sf_dir, "labels"))
    return with_score(docs, weights, "__judged").where(F.col("__judged.score") < THRESHOLD).drop("__judged")
