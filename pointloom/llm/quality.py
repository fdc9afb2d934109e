"""Quality rules: gradient-boosted trees over document statistics.

Statistics of each whole text are computed once, in the task that reads it. Trees are fitted with histograms in numpy on
a bounded sample of labelled rows (``max_rows``, chosen by hash), with monotonic constraints: more symbols, repeated
lines, repeated words or capitals never raise a score. The fitted trees are flattened into node arrays, and a batch of
documents walks all trees level by level.

Defined results: null and blank texts have zero words and fail the base rules; without labels of both kinds no tree is
fitted and the base rules decide alone; ties in the sample's hash are all taken; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import append

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Statistic and the direction in which a score may follow it (0: any).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": -1, "digits": 0, "distinct": 0, "line_words": 0, "marks": 0}


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            counts: dict = {}
            for w in windows:
                counts[w] = counts.get(w, 0) + 1
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    covered[i : i + 5] = b"\1\1\1\1\1"
            repeated = sum(covered)
    return n, chars, symbols, dup, repeated


def features(text: str | None, stats: tuple[int, int, int, int, int]) -> list[float]:
    n, chars, symbols, dup, repeated = stats
    if not n:
        return [0.0] * len(FEATURES)
    lines = text.count("\n") + 1
    capitals = sum(map(str.isupper, text)) if not text.isascii() else sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, ".,;:!?"))
    return [float(np.log1p(n)), chars / n, symbols / chars, dup / lines, repeated / n, capitals / chars, digits / chars, len(set(text.encode().split())) / n, n / lines, marks / n]


@dataclass
class Trees:
    """Node arrays of all trees; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row of x."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            go = x[row, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(go, self.left[node], self.right[node]))
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 20, penalty: float = 1.0) -> Trees:
    """Boost log loss; a split on a constrained feature must order its sides, and bounds pass down to their subtrees."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(p / (1 - p)))
    raw = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = node()
        g, h = grad[rows].sum(), hess[rows].sum()
        out = float(np.clip(-g / (h + penalty), low, high))
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (grad[rows], hess[rows], None))
                vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-(g - gl) / (h - hl + penalty), low, high)
                gain = (gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)) / 2
                ok = (nl >= least) & (len(rows) - nl >= least) & (signs[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j < 0:
            value[me] = rate * out
            raw[rows] += rate * out
            return me
        feature[me], threshold[me] = j, float(edges[j][k])
        middle = (vl + vr) / 2
        bounds = ((low, high), (low, high)) if not signs[j] else ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle))
        side = binned[rows, j] <= k
        left[me] = grow(rows[side], level + 1, *bounds[0])
        right[me] = grow(rows[~side], level + 1, *bounds[1])
        return me

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, prob * (1 - prob)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), bias, depth)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _fields() -> list[T.StructField]:
    return [T.StructField(c, T.LongType()) for c in STATS]


def fit_labelled(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Trees | None:
    """Trees from at most about max_rows labelled documents, chosen by hash of their id; None without both labels."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
    n = known.count()
    if not n:
        return None
    part = int(min(1.0, max_rows / n) * (1 << 52))
    sample = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 52)) < part)
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "_id").select("_y", "text")

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([features(s, base(s)) for s in texts.to_pylist()], pa.list_(pa.float64()))]

        return work

    got = append(rows, ["text"], [T.StructField("x", T.ArrayType(T.DoubleType()))], make, drop=("text",)).toPandas()
    if got["_y"].nunique() < 2:
        return None
    x = np.array(got["x"].tolist())
    order = np.lexsort([*x.T, got["_y"].to_numpy()])  # the fit must not depend on the order of rows
    return fit(x[order], got["_y"].to_numpy()[order], np.array(list(FEATURES.values())))


def judge(docs: DataFrame, trees: Trees | None, threshold: float = 0.3, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the base statistics, base_failed, score (null without trees) and kept."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            body = texts.to_pylist()
            stats = [base(s) for s in body]
            failed = np.array([n < 10 or 100 * r > 20 * n for n, _, _, _, r in stats], bool)
            if trees is None:
                score, kept = pa.nulls(len(body), pa.float64()), ~failed
            else:
                p = trees.score(np.array([features(s, st) for s, st in zip(body, stats, strict=True)]).reshape(-1, len(FEATURES)))
                score, kept = pa.array(p), ~failed & (p >= threshold)
            return [*(pa.array(c, pa.int64()) for c in zip(*stats, strict=True)), pa.array(failed), score, pa.array(kept)]

        return work

    fields = [*_fields(), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return append(docs, [text], fields, make, drop=drop)
