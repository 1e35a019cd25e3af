"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over one feature at a time, on the gradient
of the log loss in the feature's bins; their sum is one lookup table for each
feature. Pairs of features whose joint bins explain most of what is left get
two-dimensional tables, boosted the same way. A score is a logistic function of
the sum of looked-up values: only searches in bin edges and additions.

Nulls and empty texts get the features of "" and a defined score. Repeated rows
score alike. Extra columns stay. Without labels every score is 0.5; with labels
of one kind alone it is near that kind's.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, free_name, labelled_sample, table

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bound of the training sample in rows; whole texts are measured where they lie, and only features reach the driver.
SAMPLE_ROWS = 20_000
BINS, PAIRS, PAIR_BINS = 32, 8, 8

FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "symbols", "exclamations", "bars", "upper", "digits",
    "distinct_words", "adjacent_repeats", "distinct_triples", "distinct_lines", "words_a_stop", "short_words", "line_words", "symbol_endings",
)
_ENDS = re.compile(rb"[#$%&*!|~^=<>@]+(?=\s|$)")
_CLASS = np.zeros(256, dtype=np.intp)
for _name, _chars in enumerate((b"#$%&*~^=<>@\\{}[]_+", b"!", b"|", bytes(range(65, 91)), bytes(range(48, 58)), b".?!", b"\n", bytes(range(97, 123)) + bytes(range(128, 256))), 1):
    if _name == 6:
        continue
    for _c in _chars:
        _CLASS[_c] = _name


def features(text: str | None) -> tuple[float, ...]:
    """The FEATURES of a text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    words = text.split()
    k = max(1, len(words))
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) if raw else np.zeros(9)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    triples = set(zip(words, words[1:], words[2:], strict=False))
    repeats = sum(map(str.__eq__, words, words[1:]))
    stops = raw.count(b".") + raw.count(b"?") + c[2]
    return (
        float(np.log1p(len(text))), float(np.log1p(len(words))), len(text) / k, float(lengths.max()), c[1] / n, c[2] / n, c[3] / n,
        c[4] / max(1, c[4] + c[8]), c[5] / n, len(set(words)) / k, repeats / k, len(triples) / max(1, k - 2), len(set(lines)) / len(lines),
        k / (stops + 1), float((lengths <= 3).mean()), k / len(lines), len(_ENDS.findall(raw)) / k,
    )


def _split(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """The best cut of a row of bins into two: gain, and the size of the left part (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - g.sum() ** 2 / (h.sum() + lam)
    gain[(hl < 1e-3) | (hr < 1e-3)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, lam: float, depth: int = 2) -> np.ndarray:
    """A tree of the given depth over bins in order, as a value for each bin."""
    _, at = _split(g, h, lam) if depth else (0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + lam))
    return np.concatenate([_tree(g[:at], h[:at], lam, depth - 1), _tree(g[at:], h[at:], lam, depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
    """A tree over two features: the best first cut along either, then each side cut along the other."""
    (a, i), (b, j) = _split(g.sum(1), h.sum(1), lam), _split(g.sum(0), h.sum(0), lam)
    if not i and not j:
        i, a = max(1, len(g) // 2), 1
    if a >= b and i:
        return np.vstack([np.tile(_tree(g[s].sum(0), h[s].sum(0), lam, 1), (g[s].shape[0], 1)) for s in (slice(0, i), slice(i, None))])
    return _tree2(g.T, h.T, lam).T if i == 0 or b > a else np.zeros_like(g)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 60, rate: float = 0.1, lam: float = 2.0) -> dict:
    """Bin edges, one table a feature, and tables of the strongest pairs."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        rest = (4.0 if y[0] > 0 else -4.0) if n else 0.0
        return {"edges": [np.zeros(0)] * d, "tables": [np.zeros(1)] * d, "pairs": [], "pair_edges": [np.zeros(0)] * d, "bias": rest}
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(d)]
    at = [np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)]
    low = [np.searchsorted(coarse[j], x[:, j], side="left") for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    bias = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(n, bias)

    def grad() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = grad()
            k = len(tables[j])
            step = rate * _tree(np.bincount(at[j], g, k), np.bincount(at[j], h, k), lam)
            tables[j] += step
            z += step[at[j]]
    g, h = grad()
    found = []
    for a, b in itertools.combinations(range(d), 2):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = low[a] * shape[1] + low[b]
        gg, hh = (np.bincount(cell, v, shape[0] * shape[1]) for v in (g, h))
        found.append((-float((gg**2 / (hh + lam)).sum()), a, b, shape))
    pairs = [[a, b, np.zeros(shape)] for _, a, b, shape in sorted(found)[:PAIRS]]
    for _ in range(pair_rounds):
        for a, b, t in pairs:
            g, h = grad()
            cell = low[a] * t.shape[1] + low[b]
            step = rate * _tree2(np.bincount(cell, g, t.size).reshape(t.shape), np.bincount(cell, h, t.size).reshape(t.shape), lam)
            t += step
            z += step[low[a], low[b]]
    return {"edges": edges, "tables": tables, "pairs": [tuple(p) for p in pairs], "pair_edges": coarse, "bias": bias}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of rows of features: bins looked up and added."""
    x = np.asarray(x, dtype=float).reshape(-1, len(model["edges"]))
    z = np.full(len(x), model["bias"])
    for j, (e, t) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        z += t[np.searchsorted(e, x[:, j], side="left")]
    for a, b, t in model["pairs"]:
        z += t[np.searchsorted(model["pair_edges"][a], x[:, a], side="left"), np.searchsorted(model["pair_edges"][b], x[:, b], side="left")]
    return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on features of the bounded sample of labelled documents outside the held-out fold."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(map(float, features(t))))

    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE_ROWS)
    got = sample.select("doc_id", "label", measured("text").alias("x")).toPandas().sort_values("doc_id")
    return train(np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)), got["label"].to_numpy(dtype=float).clip(0, 1))


def with_score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """docs with the score of each whole text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(model, np.array([features(t) for t in texts], dtype=float)))

    return docs.withColumn(column, score("text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without those that are scored poor; a column of any name stays as it is."""
    score = free_name(docs, "_quality")
    return with_score(docs, fit(docs, table(spark, sf_dir, "labels")), score).where(F.col(score) >= THRESHOLD).drop(score)
