"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability of being toxic is a
logistic function of its words; the document's is their noisy-or,
1 - prod(1 - p). Only documents carry labels: the gradient of the document's
likelihood flows through the noisy-or into the sentences, so the model learns
which sentences offend without being told.

Features of a word are the word itself and its beginnings of 3, 4 and 5
letters, which catch inflected forms. A sentence without any known feature has
probability 0, so long clean texts gather no score from their length.

Nulls and empty texts score 0.0. Repeated rows score alike. Extra columns stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold, free_name, labelled_sample, table

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bound of the training sample in rows. Words are counted where the texts lie; the driver gets the known features of each sentence.
SAMPLE_ROWS = 5000
#: Bound of the lexicon, so of the model that tasks get.
MAX_FEATURES = 5000
#: Toxic documents of a feature at least.
LEAST = 3

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def _features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in (3, 4, 5) if len(word) >= n)]


def _bag(text: str | None) -> list[list[str]]:
    """The words of each sentence."""
    return [_WORD.findall(s) for s in _SENTENCE.split((text or "").lower())]


def _lexicon(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> dict[str, int]:
    """Features that are clearly more frequent in toxic documents, by log-odds and count; counts: toxic and other documents of each feature."""
    found = []
    n1, n0 = max(1, n1), max(1, n0)
    for f, (a, b) in counts.items():
        odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))
        error = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= LEAST and odds >= 1.5 and odds / error >= 2.5:
            found.append((-odds / error, f))
    return {f: i for i, (_, f) in enumerate(sorted(found)[:MAX_FEATURES])}


def _known(bag: list[list[str]], lexicon: dict[str, int]) -> list[list[int]]:
    """The known features of each sentence that has any."""
    return [k for words in bag if (k := [lexicon[f] for w in words for f in _features(w) if f in lexicon])]


def train(texts: list[str], y: np.ndarray, **how) -> dict:
    """The weights by feature and the bias; {} weights if nothing tells the classes apart."""
    y = np.asarray(y, dtype=float)
    bags = [_bag(t) for t in texts]
    counts: dict[str, list[int]] = {}
    for bag, label in zip(bags, y, strict=True):
        for f in {f for sentence in bag for w in set(sentence) for f in _features(w)}:
            counts.setdefault(f, [0, 0])[0 if label else 1] += 1
    lexicon = _lexicon({f: (a, b) for f, (a, b) in counts.items()}, int(y.sum()), int(len(y) - y.sum()))
    return ascend([_known(b, lexicon) for b in bags], y, lexicon, **how)


def ascend(bags: list[list[list[int]]], y: np.ndarray, lexicon: dict[str, int], steps: int = 250, l2: float = 2e-4, rate: float = 0.15) -> dict:
    """The weights that make the labels of bags of sentences, given as their features, likeliest."""
    doc_of, feature, sentence = [], [], []
    for d, bag in enumerate(bags):
        for known in bag:
            feature += list(known)
            sentence += [len(doc_of)] * len(known)
            doc_of.append(d)
    if not doc_of:
        return {"weights": {}, "bias": -4.0}
    doc_of, feature, sentence = (np.asarray(x) for x in (doc_of, feature, sentence))
    n, k = len(doc_of), len(lexicon)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = -1.0
    for step in range(1, steps + 1):
        z = np.clip(np.bincount(sentence, w[feature], n) + w[k], -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        pull = np.where(y[doc_of] > 0, -(clean / np.maximum(1 - clean, 1e-9))[doc_of] * p, p)
        g = np.append(np.bincount(feature, pull[sentence], k), pull.sum()) / len(y) + l2 * np.append(w[:k], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"weights": {f: float(w[i]) for f, i in lexicon.items()}, "bias": float(w[k])}


class Scorer:
    """Scores texts in a task; remembers words, at most a set number of them."""

    def __init__(self, model: dict, remembered: int = 300_000):
        self.weights, self.bias, self.most, self.known = model["weights"], model["bias"], remembered, {}

    def word(self, w: str) -> float | None:
        """The word's weight; None if no feature of it is known."""
        if w in self.known:
            return self.known[w]
        if len(self.known) >= self.most:
            self.known.clear()
        found = [self.weights[f] for f in _features(w) if f in self.weights]
        self.known[w] = z = sum(found) if found else None
        return z

    def sentences(self, text: str) -> list[tuple[int, str, float]]:
        """(number, sentence, probability) of sentences with a known feature."""
        out = []
        for i, s in enumerate(_SENTENCE.split(text)):
            z = [x for w in _WORD.findall(s.lower()) if (x := self.word(w)) is not None]
            if z:
                out.append((i, s.strip(), 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(z) + self.bias))))))
        return out

    def score(self, text: str | None) -> float:
        if not text or all(self.word(w) is None for w in set(_WORD.findall(text.lower()))):
            return 0.0
        return 1 - math.prod(1 - p for _, _, p in self.sentences(text))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on the bounded sample of labelled documents outside the held-out fold."""
    scratch = Scratch(docs.sparkSession)
    sample = scratch.written(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE_ROWS).withColumn("label", F.when(F.col("label") > 0, 1).otherwise(0)), "sample")

    @F.pandas_udf("array<string>")
    def kinds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({f for w in set(_WORD.findall(t.lower())) for f in _features(w)}))

    counted = sample.select("label", F.explode(kinds("text")).alias("f")).groupBy("f").agg(F.sum("label").cast("long").alias("a"), F.count("*").alias("n")).where(F.col("a") >= LEAST)
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # only features of toxic documents come here, which the sample's rows bound
    counts = {r["f"]: (r["a"], r["n"] - r["a"]) for r in counted.collect()}
    lexicon = _lexicon(counts, totals.get(1, 0), totals.get(0, 0))

    @F.pandas_udf("array<array<int>>")
    def known(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _known(_bag(t), lexicon))

    got = sample.select("doc_id", "label", known("text").alias("bag")).toPandas().sort_values("doc_id")
    scratch.clear()
    return ascend(got["bag"].tolist(), got["label"].to_numpy(dtype=float), lexicon)


def with_score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """docs with the noisy-or score of each whole text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield texts.map(scorer.score).astype(float)

    return docs.withColumn(column, score("text"))


def offending_sentences(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, sentence_no, sentence, p) of the sentences at or over the threshold."""

    @F.pandas_udf("array<struct<sentence_no:int,sentence:string,p:double>>")
    def located(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield texts.map(lambda t: [{"sentence_no": i, "sentence": s, "p": p} for i, s, p in scorer.sentences(t or "") if p >= threshold])

    return docs.select("doc_id", F.explode(located("text")).alias("s")).select("doc_id", "s.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without those that are scored toxic; a column of any name stays as it is."""
    score = free_name(docs, "_toxicity")
    return with_score(docs, fit(docs, table(spark, sf_dir, "labels")), score).where(F.col(score) < THRESHOLD).drop(score)
