"""Language identification by hierarchical discrimination.

First a language family is predicted (one linear SVM per family against the
rest), then one-versus-one linear SVMs separate the languages within it.
Texts are described by hashed counts of byte trigrams of letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, one_row_each, parts

DIMS = 1 << 12
#: Rows of each language that the classifier is fitted on, at most about.
PER_LANGUAGE = 600
#: Rows of all languages together, at most about: each is DIMS floats on the driver.
SAMPLE_ROWS = 4000
UNDETERMINED = "und"

# Language families (fixed values). A language not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "semitic": ["ar", "he", "mt"],
    "turkic": ["tr", "az", "kk"],
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

# A-Z in lower case, other ASCII characters that are no letters as a space.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_FOLD[:128][~_LETTER[_FOLD[:128]]] = 32


def trigram_features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One unit vector per text: square roots of the shares of hashed byte
    trigrams, with a space before and two after each text."""
    n, size = len(off) - 1, np.diff(off)
    padded = np.full(len(buf) + 3 * n, 32, np.uint32)
    padded[np.arange(len(buf)) + np.repeat(3 * np.arange(n) + 1, size)] = _FOLD[buf]
    tri = padded[:-2] | (padded[1:-1] << 8) | (padded[2:] << 16)
    row = np.repeat(np.arange(n), size + 3)[:-2]
    letters = tri != 0x202020
    cell = (tri[letters] * np.uint32(2654435761)) >> np.uint32(32 - 12)
    counts = np.bincount(row[letters] * DIMS + cell, minlength=n * DIMS).reshape(n, DIMS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    found = np.zeros(len(off) - 1, bool)
    ascii_letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTER[_FOLD[buf]] & (buf < 128), out=ascii_letters[1:])
    found = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, buf[off[i]: off[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by
    accelerated gradient steps; ``y`` is +1 or -1, rows of ``x`` have length 1.
    Both classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    rate, t = 1 / (4 + penalty), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * y * weight
        grad = penalty * v - 2 * np.append(slack @ x, slack.sum()).astype(np.float32)
        new = v - np.float32(rate) * grad
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + np.float32((t - 1) / t_next) * (new - w), new, t_next
    return w


class Hierarchy:
    """The fitted classifier: ``families`` against the rest, then pairs."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        lang = np.array([self.langs.index(v) for v in langs])
        family_of = [_FAMILY_OF.get(v, v) for v in self.langs]
        self.families = sorted(set(family_of))
        self.members = [[k for k, f in enumerate(family_of) if f == name] for name in self.families]
        family = np.array([self.families.index(family_of[k]) for k in lang])
        one = [linear_svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in range(len(self.families))]
        self.family_weights = np.array(one, np.float32)
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        for members in self.members:
            for a, b in combinations(members, 2):
                at = (lang == a) | (lang == b)
                self.pairs[a, b] = linear_svm(x[at], np.where(lang[at] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score for each row. The score is the family's
        share times the mean preference of the language over its relatives."""
        def preference(w: np.ndarray, at: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-4 * np.clip(x[at] @ w[:-1] + w[-1], -20, 20)))

        everyone = np.arange(len(x))
        shares = np.stack([preference(w, everyone) for w in self.family_weights], 1)
        shares = shares / shares.sum(1, keepdims=True)
        family = shares.argmax(1)
        lang, score = np.zeros(len(x), np.int64), shares.max(1)
        for f, members in enumerate(self.members):
            at = np.flatnonzero(family == f)
            if not len(at):
                continue
            votes, liking = np.zeros((len(at), len(members))), np.zeros((len(at), len(members)))
            for a, b in combinations(range(len(members)), 2):
                p = preference(self.pairs[members[a], members[b]], at)
                for k, q in ((a, p), (b, 1 - p)):
                    votes[:, k] += q > 0.5
                    liking[:, k] += q
            best = (votes + liking / (len(members) + 1)).argmax(1)
            lang[at] = np.array(members)[best]
            if len(members) > 1:
                score[at] *= liking[np.arange(len(at)), best] / (len(members) - 1)
        return lang, np.clip(score, 0, 1)


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Hierarchy | None:
    """Fit on a bounded sample (about ``per_language`` rows of each language,
    SAMPLE_ROWS in all) of the rows where ``learn`` holds and lang and text are
    not null. None if there is no such row."""
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in parts(batch.column("text"), rows=256):
                x = trigram_features(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    n = rows.select("lang").distinct().limit(1001).count()
    sample = bounded_sample(rows, F.col("doc_id"), "lang", min(per_language, max(4, SAMPLE_ROWS // max(n, 1))))
    # an id that repeats counts once, so the rows that reach the driver are bounded too
    got = one_row_each(sample, "doc_id").select("lang", "text").mapInArrow(features, "lang string, x binary").collect()
    got = sorted((r["lang"], bytes(r["x"])) for r in got)
    if not got:
        return None
    return Hierarchy(np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(len(got), DIMS), [v for v, _ in got])


def identify(docs: DataFrame, model: Hierarchy | None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with lang_pred and score.

    ``und`` with score 0 for a text that is null or has no letter; every other
    text gets a learned language, ``und`` only where nothing could be learned.
    """
    names = docs.columns if carry is None else carry
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for _, _, buf, off in parts(batch.column("text"), rows=256):
                letters = _has_letter(buf, off)
                if model is None:
                    k, s = np.zeros(len(letters), np.int64), np.zeros(len(letters))
                else:
                    k, s = model.predict(trigram_features(buf, off))
                pred += [model.langs[a] if model and b else UNDETERMINED for a, b in zip(k, letters)]
                score += np.where(letters, s, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                [*names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)
