"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone, in numpy on the executors. Trees are grown
level by level from histograms of binned statistics, and flattened into arrays
(feature, threshold and leaf by node number), so that scoring is a few vectorised
steps for all rows and trees at once.

The sample to learn from is bounded by ``max_rows``: labelled rows with the
smallest hashes of their id. Only their statistics reach the driver.

Defined cases: null and empty texts have all statistics 0 and get a score like
any text; no labels, or labels of one class, give the constant share of class 1
(0.5 without any); repeated ids are learnt once; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import measure
from .text import Chunk, chunks, distinct_values, span_sums

_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "shout": [33],
    "stops": [44, 46, 59],
    "bar": [124],
    "wide": range(128, 256),
}


def _flags(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_FLAGS = {k: _flags(v) for k, v in _CLASSES.items()}


def statistics(chunk: Chunk) -> np.ndarray:
    """float32 matrix, a row for each text."""
    m = measure(chunk)
    words = np.maximum(m["n_words"], 1)
    size = np.maximum(np.diff(chunk.bounds), 1)
    lines = np.maximum(m["n_lines"], 1)
    h, text = chunk.word_hashes(), chunk.text_of_word
    keys = distinct_values((text.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    distinct = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=chunk.n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    short = (chunk.ends - chunk.starts) <= 3
    columns = [
        np.log1p(m["n_words"]),
        m["word_chars"] / words,
        m["n_symbols"] / words,
        m["n_dup_lines"] / lines,
        m["n_repeat_words"] / words,
        m["n_words"] / lines,
        distinct / words,
        span_sums(again, chunk.word_bounds) / words,
        span_sums(short, chunk.word_bounds) / words,
        *(chunk.sums(f[chunk.data]) / (words if k in ("shout", "stops", "bar") else size) for k, f in _FLAGS.items()),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


N_STATISTICS = 9 + len(_FLAGS)


@dataclass
class Trees:
    """Complete binary trees in arrays of shape (trees, nodes); node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        total = np.full(len(x), self.base)
        if len(self.feature):
            trees, inner = self.feature.shape
            row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
            node = np.zeros((len(x), trees), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total = total + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, min_rows: int = 8) -> Trees:
    """Newton boosting of the logistic loss. A node without a split worth making sends all its rows left."""
    none = np.zeros((0, 2**depth - 1))
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < mean < 1:
        return Trees(none.astype(np.int64), none, np.zeros((0, 2**depth)), float(np.log((mean * len(y) + 0.5) / ((1 - mean) * len(y) + 0.5))) if len(y) else 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), base)
    inner = 2**depth - 1
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = node - first
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                size = width * (len(c) + 1)
                key = local * (len(c) + 1) + binned[:, j]
                G, H, N = (np.bincount(key, w, size).reshape(width, -1) for w in (g, h, None))
                gl, hl, nl = (np.cumsum(a, axis=1)[:, :-1] for a in (G, H, N))
                gt, ht, nt = (a.sum(axis=1, keepdims=True) for a in (G, H, N))
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < min_rows) | (nt - nl < min_rows)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k], features[t, first + k], thresholds[t, first + k] = top[k], j, c[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        leaves[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        total = total + leaves[t][leaf]
    return Trees(features, thresholds, leaves, base)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds) == fold


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` (id, label) with the smallest id hashes; of repeated ids the larger label."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = rows.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    top = one.orderBy(F.xxhash64(id_col), id_col).limit(max_rows).collect()
    return labels.sparkSession.createDataFrame([(r[0], r[1]) for r in top], "_id bigint, _label int")


def _each(text: Column, f, kind: str) -> Column:
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield f(texts)

    return F.arrow_udf(run, kind)(text)


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, N_STATISTICS), np.float32), *(statistics(c) for c in chunks(texts))])


def _lists(texts: pa.Array) -> pa.Array:
    x = _matrix(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATISTICS), pa.array(x.ravel()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8000) -> Trees:
    sample = labelled_sample(labels, id_col, label_col, max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.select("_id", "_label", _each(F.col("_text"), _lists, "array<float>").alias("x")).groupBy("_id", "_label").agg(F.max("x").alias("x"))
    got = sorted(rows.collect(), key=lambda r: r["_id"])
    x = np.array([r["x"] for r in got], np.float32).reshape(-1, N_STATISTICS)
    return fit(x, np.array([r["_label"] for r in got], float))


def score(model: Trees, text: Column) -> Column:
    return _each(text, lambda texts: pa.array(model.score(_matrix(texts)), pa.float64()), "double")
