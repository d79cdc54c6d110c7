"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
#: At most so many labelled rows are fitted, those with the smallest hash of their id.
MAX_FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, MIN_ROWS, L2 = 80, 4, 64, 0.15, 20, 1.0

FEATURES = [
    "log_bytes", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "spaces", "newlines",
    "sentence_marks", "exclaims", "pipes", "symbols", "control", "non_ascii", "line_length", "longest_line",
    "repeated_lines", "repeated_line_bytes", "distinct_words", "commonest_word", "distinct_pairs", "ends_in_mark",
    "one_letter_words", "distinct_bytes", "longest_run",
]


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; null and empty texts are all zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    b = np.frombuffer(data, np.uint8)
    h = np.bincount(b, minlength=256) / n
    words = data.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    m = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen = Counter(lines)
    again = sum(k - 1 for k in seen.values())
    again_bytes = sum((k - 1) * len(x) for x, k in seen.items())
    lengths = [len(x) for x in lines] or [0]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 1.0
    marks = sum(map(h.__getitem__, b".,;:?"))
    symbols = sum(map(h.__getitem__, b"#$%&*@^~=+<>{}[]\\/_`\"'()"))
    change = np.flatnonzero(b[1:] != b[:-1])
    run = int(np.diff(np.concatenate([[-1], change, [n - 1]])).max())
    ended = sum(w[-1] in b".,;:!?" for w in words)
    return [
        np.log1p(n), np.log1p(len(words)), float(sizes.mean()), np.log1p(float(sizes.max())),
        h[65:91].sum() + h[97:123].sum(), h[65:91].sum(), h[48:58].sum(), h[32], h[10], marks, h[33], h[124],
        symbols, h[:9].sum() + h[14:32].sum(), h[128:].sum(), n / max(1, len(lines)), np.log1p(max(lengths)),
        again / max(1, len(lines)), again_bytes / n, len(counts) / m, max(counts.values(), default=0) / m, pairs,
        ended / m, float((sizes == 1).sum()) / m, float((h > 0).sum()), np.log1p(run)]


@dataclass
class Trees:
    """Complete binary trees in arrays: node i of a tree has children 2i+1 and 2i+2.

    ``feature`` and ``edge`` are [tree, inner node], ``value`` is [tree, leaf].
    An unsplit node has an infinite edge, so everything goes left.
    """
    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    start: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all trees of all rows going down a level at a time."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        trees, inner = np.arange(len(self.feature))[None, :], self.feature.shape[1]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.edge[trees, node])
        return 1 / (1 + np.exp(-(self.start + self.value[trees, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost trees on the logistic loss; splits are searched on histograms of at most BINS bins a feature.

    The rows' order does not matter beyond rounding. With no rows the score
    is 0.5, with one class its smoothed share.
    """
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 0.0,
                     float((y.sum() + 0.5) / (len(y) + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
             for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # bin k: x <= e[k]
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), start)
    inner, n_leaves = (1 << depth) - 1, 1 << depth
    feature, edge = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, n_leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.zeros(width)
            split = np.full(width, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = local * BINS + binned[f]
                hg, hh, hn = (np.bincount(at, w, width * BINS).reshape(width, BINS).cumsum(axis=1)
                              for w in (g, h, np.ones(len(y))))
                lg, lh, ln = hg[:, :len(e)], hh[:, :len(e)], hn[:, :len(e)]
                tg, th, tn = hg[:, -1:], hh[:, -1:], hn[:, -1:]
                gain = lg ** 2 / (lh + L2) + (tg - lg) ** 2 / (th - lh + L2) - tg ** 2 / (th + L2)
                gain[(ln < MIN_ROWS) | (tn - ln < MIN_ROWS)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                won = top > best + 1e-9
                best[won], split[won] = top[won], k[won]
                feature[t, first:first + width][won] = f
            for j in np.flatnonzero(split >= 0):
                edge[t, first + j] = edges[feature[t, first + j]][split[j]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > edge[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, g, n_leaves) / (np.bincount(leaf, h, n_leaves) + L2)
        raw += value[t, leaf]
    return Trees(feature, edge, value, start)


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, mod 4, is 2 (null ids: held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _statistics(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<double>")(text)


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> Trees:
    """Trees fitted on at most ``max_fit_rows`` labelled documents that are not held out.

    The sample is the labels with the smallest hash of their id, whatever
    the tables' sizes or order. Null labels and ids are no labels; of several
    labels of one id the least counts, of several texts the one with the
    least statistics.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(
        F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(
        F.min("_y").alias("_y")).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(max_fit_rows)
    # at most max_fit_rows (id, label) pairs are broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    sample = rows.groupBy("_id", "_y").agg(F.min(_statistics(F.col("_text"))).alias("_x")).collect()
    sample.sort(key=lambda r: str(r["_id"]))
    return fit(np.array([r["_x"] for r in sample], float).reshape(-1, len(FEATURES)),
               np.array([r["_y"] for r in sample], float))


def score(model: Trees, text: Column) -> Column:
    """The score of each whole text; null and empty texts score as all-zero statistics."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))))

    return F.pandas_udf(run, "double")(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", max_fit_rows: int = MAX_FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """One row per document row: id, held_out, score, predicted (1 from ``threshold`` on).

    See :func:`fit_documents` for what is learned from; texts alone enter a score.
    """
    model = fit_documents(docs, labels, id_col, text_col, label_col, max_fit_rows)
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"),
                       score(model, F.col(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns; repeated rows are judged alike."""
    return docs.where(score(fit_documents(docs, labels, id_col, text_col), F.col(text_col)) >= threshold)
