"""Quality classifier (operator 3): histogram gradient-boosted trees over document statistics.

Trees are grown level by level from binned gradients and flattened into arrays, which all
documents of a batch walk at once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Bound of the fit: labelled documents, chosen by a hash of the id.
FIT_ROWS = 12_000
TREES, LEVELS, BINS, RATE, LEAST = 80, 4, 64, 0.15, 15

STATS = (
    "chars words word_chars upper digits spaces newlines punct wide symbols bangs pipes "
    "distinct_words adjacent_repeats top_word lines distinct_lines longest_word mean_line repeats3"
).split()
_CLASSES = np.zeros((256, 8), np.float64)
for _k, _of in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".,;:'\"()-?", "", "#*$%&<>", "!")):
    _CLASSES[[ord(c) for c in _of], _k] = 1
_CLASSES[128:, 5] = 1
_PIPE = ord("|")
_WORD = re.compile(r"\S+")


def document_stats(text: str | None) -> list[float]:
    """STATS of a whole text; shares are of bytes, words or lines.  Null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    hist = np.bincount(raw, minlength=256)
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    counts = Counter(words)
    threes = max(1, len(words) - 2)
    shares = (hist @ _CLASSES / n).tolist()
    return [
        float(len(text)), float(len(words)), sum(map(len, words)) / m, *shares, hist[_PIPE] / n,
        len(counts) / m, sum(map(eq, words, words[1:])) / m, max(counts.values(), default=0) / m,
        float(len(lines)), len(set(lines)) / len(lines), float(max(map(len, words), default=0)), len(text) / len(lines),
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / threes if len(words) > 2 else 0.0,
    ]


@dataclass
class Trees:
    """All trees as arrays: node i tests feature[i] <= cut[i] and goes to 2i+1 or 2i+2 of its tree."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += v[at - (2**LEVELS - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted logistic regression trees; with one class or no rows, its smoothed share."""
    inner, leaves = 2**LEVELS - 1, 2**LEVELS
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 * LEAST or y.min() == y.max():
        none = np.zeros((0, inner))
        return Trees(none.astype(np.int64), none, np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    raw, out = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(LEVELS):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-9)
            bin_cut = np.full(width, BINS)
            for k, e in enumerate(edges):
                key = local * BINS + binned[:, k]
                gs, hs, ns = (np.bincount(key, w, width * BINS).reshape(width, BINS) for w in (g, h, None))
                gl, hl, nl = gs.cumsum(1), hs.cumsum(1), ns.cumsum(1)
                G, H, N = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                gain[(nl < LEAST) | (N - nl < LEAST)] = 0
                gain = gain[:, : len(e)]
                if not gain.size:
                    continue
                j = gain.argmax(1)
                top = gain[np.arange(width), j]
                for node in np.flatnonzero(top > best):
                    best[node], feature[first + node], cut[first + node], bin_cut[node] = top[node], k, e[j[node]], j[node]
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > bin_cut[local])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        raw += value[leaf]
        out.append((feature, cut, value))
    return Trees(*(np.stack(z) for z in zip(*out, strict=True)), base)


def _with_stats(docs: DataFrame) -> DataFrame:
    shared.text_batches(docs.sparkSession)

    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([document_stats(t) for t in texts])

    stats.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.withColumn("stats", F.pandas_udf(stats, "array<double>")(F.col("text").cast("string")))


def fit(docs: DataFrame, labels: DataFrame, eligible=None, rows: int = FIT_ROWS) -> Trees:
    """Learn ``labels.quality`` from at most ``rows`` labelled documents; null labels teach nothing."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    known = known if eligible is None else known.where(eligible)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)  # so small that it is broadcast
    found = _with_stats(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")).select("doc_id", "quality", "stats").collect()
    found.sort(key=lambda r: (r["doc_id"], r["quality"]))
    x = np.array([r["stats"] for r in found]).reshape(len(found), len(STATS))
    return train(x, np.array([float(r["quality"] > 0) for r in found]))


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5); every row has one, empty texts too."""
    shared.text_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def score(texts: pd.Series) -> pd.Series:
        x = np.array([document_stats(t) for t in texts]).reshape(len(texts), len(STATS))
        return pd.Series(model.value.score(x))

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    scored = docs.withColumn("score", F.pandas_udf(score, "double")(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    trees = fit(docs, shared.table(spark, sf_dir, "labels"), ~shared.held_out(F.col("doc_id"), 3, 1))
    rows = score_quality(docs.select("doc_id", "text"), trees)
    return rows.select("doc_id", shared.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
