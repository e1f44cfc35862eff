"""Quality rules by gradient-boosted trees over document statistics.

The statistics come from one vectorised pass over the texts; the trees are
fitted on a bounded labelled sample with monotonic constraints on chosen
statistics and flattened into numpy node arrays for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, one_row_each, parts, row_sums, segment_hashes, windows, words

#: Labelled documents of each class that the trees are fitted on, at most about.
PER_CLASS = 6000
#: Documents are kept at this probability of good quality or more.
KEEP_AT = 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Statistics of the trees and the direction that quality must follow (0: free).
CONSTRAINTS = {
    "n_words": 0, "word_length": 0, "symbol_share": -1, "symbols_per_word": -1, "dup_line_share": -1,
    "repeat_share": -1, "line_length": 0, "digit_share": 0, "upper_share": 0, "punctuation_share": 0,
    "non_ascii_share": 0, "lone_symbol_share": -1,
}

# Symbols that the base rules count (fixed values of the contract).
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT, _UPPER, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = _UPPER[65:91] = True
_PUNCT[[ord(c) for c in ".,;:!?"]] = True


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of \\n-split lines, and each text's range of lines."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, off[1:]]), kind="stable")
    bounds = np.arange(len(off)) + np.searchsorted(breaks, off)
    return starts, ends, bounds


def _repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether (row, key) occurs twice or more, and whether it occurred before."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((key, row))
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    often, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    often[order], again[order] = same[1:] | same[:-1], same[:-1]
    return often, again


def base_statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, bounds = words(buf, off)
    n_words = np.diff(bounds)
    head = (buf & 0xC0) != 0x80  # first bytes of code points
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    line_start, line_end, lines = _lines(buf, off)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row = np.repeat(np.arange(len(off) - 1), np.diff(lines))
    again = np.zeros(len(line_start), bool)
    at = np.flatnonzero(worded)
    again[at] = _repeated(line_row[at], segment_hashes(buf, line_start[at], line_end[at]))[1]
    first, triples = windows(segment_hashes(buf, starts, ends), bounds, 3)
    word_row = np.repeat(np.arange(len(off) - 1), n_words)
    hit = first[_repeated(word_row[first], triples)[0]]
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[hit + k] = True
    return {
        "n_words": n_words, "word_chars": row_sums(head & ~space, off), "n_symbols": row_sums(_SYMBOL[buf], off),
        "n_dup_lines": row_sums(again, lines), "n_repeat_words": row_sums(covered, bounds),
        "n_lines": np.diff(lines), "n_chars": row_sums(head, off), "digits": row_sums(_DIGIT[buf], off),
        "upper": row_sums(_UPPER[buf], off), "punctuation": row_sums(_PUNCT[buf], off),
        "non_ascii": row_sums(head & (buf >= 0x80), off),
        "lone_symbols": row_sums((ends - starts == 1) & _SYMBOL[buf[starts]] if len(starts) else np.zeros(0, bool), bounds),
    }


def tree_statistics(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text, in the order of CONSTRAINTS."""
    w, c, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([s["n_words"], s["word_chars"] / w, s["n_symbols"] / c, s["n_symbols"] / w, s["n_dup_lines"] / lines,
                     s["n_repeat_words"] / w, s["n_chars"] / lines, s["digits"] / c, s["upper"] / c,
                     s["punctuation"] / w, s["non_ascii"] / c, s["lone_symbols"] / w], 1).astype(np.float64)


@dataclass
class Forest:
    """Flattened trees: node arrays, a leaf has feature -1 and itself as child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(self.feature[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = np.where(x[inner, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 40, depth: int = 3,
               rate: float = 0.2, smooth: float = 2.0, bins: int = 64) -> Forest:
    """Logistic gradient boosting on binned features. A split on a constrained
    feature must order its children's values, and their subtrees stay on their
    side of the middle, so every tree is monotonic in that feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else x[:, 0] for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    score = np.full(len(y), base)

    def leaf(v: float) -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(len(feature) - 1)
        right.append(len(feature) - 1)
        value.append(v)
        return len(feature) - 1

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[at].sum(), h[at].sum()
        node = leaf(rate * float(np.clip(total_g / (total_h + smooth), low, high)))
        best = (1e-6, None)
        if level < depth and len(at) >= 20:
            parent = total_g ** 2 / (total_h + smooth)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                sum_g = np.cumsum(np.bincount(binned[at, f], g[at], len(e) + 1))[:-1]
                sum_h = np.cumsum(np.bincount(binned[at, f], h[at], len(e) + 1))[:-1]
                n = np.cumsum(np.bincount(binned[at, f], minlength=len(e) + 1))[:-1]
                a, b = sum_g / (sum_h + smooth), (total_g - sum_g) / (total_h - sum_h + smooth)
                gain = sum_g ** 2 / (sum_h + smooth) + (total_g - sum_g) ** 2 / (total_h - sum_h + smooth) - parent
                gain[(n < 5) | (len(at) - n < 5)] = 0
                if constraints[f]:
                    gain[constraints[f] * (np.clip(b, low, high) - np.clip(a, low, high)) < 0] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, float(np.clip(a[k], low, high)), float(np.clip(b[k], low, high))))
        if best[1]:
            f, k, a, b = best[1]
            middle = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)),
                      -1: ((middle, high), (low, middle))}[constraints[f]]
            goes_left = binned[at, f] <= k
            feature[node], threshold[node] = f, float(edges[f][k])
            left[node] = grow(at[goes_left], g, h, level + 1, *bounds[0])
            right[node] = grow(at[~goes_left], g, h, level + 1, *bounds[1])
        return node

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        root = grow(np.arange(len(y)), y - p, p * (1 - p), 0, -4.0, 4.0)
        roots.append(root)
        one = Forest(np.array([root]), *(np.array(v) for v in (feature, threshold, left, right, value)), 0.0)
        q = np.clip(one.probability(x), 1e-12, 1 - 1e-12)
        score += np.log(q / (1 - q))
    return Forest(np.array(roots, np.int64), *(np.array(v) for v in (feature, threshold, left, right, value)), base)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the BASE statistics and the trees' statistics (an array)."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in parts(batch.column("text")):
                s = base_statistics(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), *(pa.array(s[c], pa.int64()) for c in BASE),
                     pa.array(tree_statistics(s).tolist(), pa.list_(pa.float64()))], ["doc_id", *BASE, "x"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(describe, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", x array<double>"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Forest:
    """Trees learned from ``labels.quality`` on a bounded sample: about
    ``per_class`` documents of each class, whose ids are broadcast. Only their
    statistics (a few numbers each) reach the driver. A document labelled
    twice counts as good only if every label says so."""
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
              .groupBy(F.col("doc_id").alias("marked_id")).agg(F.min("quality").cast("int").alias("y")))
    sample = F.broadcast(bounded_sample(marked, F.col("marked_id"), "y", per_class))
    rows = one_row_each(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                        .join(sample, F.col("doc_id") == F.col("marked_id")).select("doc_id", "text"), "doc_id")
    got = sorted((r["y"], tuple(r["x"])) for r in
                 statistics(rows).join(sample, F.col("doc_id") == F.col("marked_id")).select("y", "x").collect())
    x = np.array([v for _, v in got], np.float64).reshape(len(got), len(CONSTRAINTS))
    return fit_forest(x, np.array([v for v, _ in got], np.float64), [*CONSTRAINTS.values()])


def judge(docs: DataFrame, forest: Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """The BASE statistics of every whole text, base_failed, kept and quality.

    base_failed: fewer than 50 words, or over half of them in repeated word
    triples. A null or empty text has no words and fails. kept: not
    base_failed and a probability of good quality of ``keep_at`` or more;
    trees learned from no label keep all that the base rules keep.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(CONSTRAINTS))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ["doc_id", *BASE]), pa.array(forest.probability(x), pa.float64())],
                ["doc_id", *BASE, "quality"])

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (statistics(docs)
            .mapInArrow(predict, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", quality double")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
            .select("doc_id", *BASE, "base_failed", "kept", "quality"))
