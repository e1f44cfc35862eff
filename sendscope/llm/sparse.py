"""FTRL-proximal logistic regression over sparse binary features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, one_row_each, parts

BITS = 18
DIMS = 1 << BITS
#: Characters of a sampled text that are learned from, at most.
SAMPLE_CHARS = 200_000


class Ftrl:
    """Per-coordinate learning rates and L1 sparsity; the last weight is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights_at(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) > self.l1, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on a row whose features ``at`` (distinct, bias included) are 1."""
        w = self.weights_at(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, int]], epochs: int) -> tuple[np.ndarray, np.ndarray]:
        """The weights that are not 0: their places and values."""
        rows = [(np.append(at, DIMS), label) for at, label in rows]
        for _ in range(epochs):
            for at, label in rows:
                self.learn(at, label)
        w = self.weights_at(np.arange(DIMS + 1))
        places = np.flatnonzero(w)
        return places, w[places]


def fit_labels(docs: DataFrame, labels: DataFrame, label: str, learn: Column, features, per_class: int,
               epochs: int = 12, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Fit on a bounded sample of the labelled documents where ``learn`` (on
    the label's doc_id) holds: about ``per_class`` of each class.

    The sample's ids are broadcast (their number is bounded by ``per_class``),
    an id that repeats counts once, and of a very long text SAMPLE_CHARS count;
    the sampled texts are described in parallel and learned in the order of a
    hash in one task, as stochastic steps need; texts never reach the driver.
    A document labelled twice counts as 1 if any label says so.
    """
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
              .groupBy(F.col("doc_id").alias("marked_id")).agg(F.max(label).cast("int").alias("y")))
    sample = bounded_sample(marked, F.col("marked_id"), "y", per_class)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for _, _, buf, off in parts(batch.column("text")):
                row, place = features(buf, off)
                key = np.unique(row * DIMS + place)
                ends = np.searchsorted(key, np.arange(1, len(off)) * DIMS)
                found += [x.tobytes() for x in np.split((key % DIMS).astype(np.int32), ends[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("y"), pa.array(found, pa.binary())], ["h", "y", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x, np.int32), y) for batch in batches
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        places, values = Ftrl(alpha).fit(rows, epochs) if rows else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(values, pa.float64())], ["place", "w"])

    sampled = (docs.select(F.col("doc_id").cast("long"), F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS).alias("text"))
               .join(F.broadcast(sample), F.col("doc_id") == F.col("marked_id")).select("doc_id", "text", "y"))
    described = (one_row_each(sampled, "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "y", "text")
                 .mapInArrow(describe, "h long, y int, x binary"))
    got = described.repartition(1).sortWithinPartitions("h", "y").mapInArrow(train, "place long, w double").collect()
    got = sorted((r["place"], r["w"]) for r in got)
    return np.array([p for p, _ in got], np.int64), np.array([w for _, w in got])


def dense(model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = np.zeros(DIMS + 1)
    w[model[0]] = model[1]
    return w


def probabilities(w: np.ndarray, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Scores of ``n`` texts; a feature counts once per text."""
    hit = w[place] != 0
    key = np.unique(row[hit] * DIMS + place[hit])
    total = np.bincount(key // DIMS, weights=w[key % DIMS], minlength=n) + w[DIMS]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score_texts(docs: DataFrame, models: dict[str, tuple[np.ndarray, np.ndarray]], features,
                carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs``, a score column for each model, and
    n_words. The sparse weights travel with the function (at most DIMS + 1
    numbers a model)."""
    names = list(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [dense(models[c]) for c in names]
        for batch in batches:
            found: list[list[float]] = [[] for _ in names]
            n_words: list[int] = []
            for _, _, buf, off in parts(batch.column("text")):
                row, place, counts = features(buf, off, True)
                for w, out in zip(weights, found):
                    out += probabilities(w, row, place, len(off) - 1).tolist()
                n_words += counts.tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), *(pa.array(x, pa.float64()) for x in found), pa.array(n_words, pa.int64())],
                [*carry, *names, "n_words"])

    schema = T.StructType([docs.schema[c] for c in carry])
    for c in names:
        schema.add(c, "double")
    return docs.mapInArrow(score, schema.add("n_words", "long"))


def joined(rows: Iterable[np.ndarray], places: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*rows]), np.concatenate([*places])
