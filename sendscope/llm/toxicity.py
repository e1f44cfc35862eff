"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams
(one and two words) and skip-grams (two words with one or two between)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, mix, segment_hashes, words
from .sparse import BITS, fit_labels, joined, score_texts

#: Labelled documents of each class that the weights are fitted on, at most about.
PER_CLASS = 4000

#: Learning rate and epochs with the least log loss in four-fold cross-validation
#: within the learning rows of sf0.1; no held-out label took part.
ALPHA, EPOCHS = 2.0, 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def gram_features(buf: np.ndarray, off: np.ndarray, with_counts: bool = False):
    """Row and hashed place of every word, word pair and skip pair. Words are
    in lower case (A-Z) and without ASCII punctuation at their ends."""
    starts, ends, bounds = words(buf, off)
    for _ in range(3):  # up to three marks at either end
        if len(starts):
            inner = ends - starts > 1
            ends = ends - (inner & _PUNCTUATION[buf[ends - 1]])
            inner = ends - starts > 1
            starts = starts + (inner & _PUNCTUATION[buf[starts]])
    h = segment_hashes(_LOWER[buf], starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    rows, places = [row], [h >> U(64 - BITS)]
    for gap, salt in ((1, 0x51), (2, 0x52), (3, 0x53)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = mix(h[:-gap][same] * U(3) + h[gap:][same] * U(0x9E3779B97F4A7C15) + U(salt))
            rows.append(row[gap:][same])
            places.append(pair >> U(64 - BITS))
    row, place = joined(rows, places)
    place = place.astype(np.int64)
    return (row, place, np.diff(bounds)) if with_counts else (row, place)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS):
    """Sparse weights learned from ``labels.toxic`` where ``learn`` holds."""
    return fit_labels(docs, labels, "toxic", learn, gram_features, per_class, EPOCHS, ALPHA)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of every whole
    text. A null, empty or wordless text has only the bias to go by; without
    any labelled document every score is 0.5."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return (score_texts(rows, {"score": model}, gram_features, ["doc_id"]).drop("n_words")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
