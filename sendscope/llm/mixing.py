"""Mixing to target weights with soft memberships.

A classifier learned from the ``labels`` table gives each document posteriors
over domains (``toxic``, ``low`` and ``high`` quality). Projected-gradient
least squares then fits a rate for every document, between 0 and ``max_rate``:
of all rates at which the domains' expected tokens meet the target weights,
those nearest to keeping every document once. The rates are never gathered: a
step only needs sums over the documents, and a document's rate follows from
its posteriors and one multiplier a domain.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, checkpoint, segment_hashes, words
from .sparse import BITS, fit_labels, score_texts

DOMAINS = ("high", "low", "toxic")
#: Target shares of the domains' expected tokens.
TARGETS = {"high": 0.92, "low": 0.06, "toxic": 0.02}
#: Times that a document is taken, at most: documents of a scarce domain are
#: repeated before those of the others are dropped.
MAX_RATE = 8.0
#: Labelled documents of each class that a classifier is fitted on, at most about.
PER_CLASS = 2500
#: Aggregates at most, and the distance of the shares to the targets that ends them.
STEPS, CLOSE = 60, 1e-4

_log = logging.getLogger(__name__)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_features(buf: np.ndarray, off: np.ndarray, with_counts: bool = False):
    """Row and hashed place of every word and of its last three bytes."""
    starts, ends, bounds = words(buf, off)
    low = _LOWER[buf]
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    whole = segment_hashes(low, starts, ends) >> U(64 - BITS)
    tail = segment_hashes(low, np.maximum(starts, ends - 3), ends) * U(0x9E3779B97F4A7C15) >> U(64 - BITS)
    place = np.concatenate([whole, tail]).astype(np.int64)
    row = np.concatenate([row, row])
    return (row, place, np.diff(bounds)) if with_counts else (row, place)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Classifiers of the two labels, each from a bounded sample."""
    return {
        "toxic": fit_labels(docs, labels, "toxic", F.lit(True), word_features, per_class),
        "good": fit_labels(docs, labels, "quality", F.lit(True), word_features, per_class),
    }


def posteriors(docs: DataFrame, models: dict, carry: list[str]) -> DataFrame:
    """``carry``, n_tokens (white-space words) and p_high, p_low, p_toxic (sum 1)."""
    return (score_texts(docs, {f"_{k}": m for k, m in models.items()}, word_features, carry)
            .select(*(F.col(f"`{c}`") for c in carry), F.col("n_words").alias("n_tokens"),
                    ((1 - F.col("_toxic")) * F.col("_good")).alias("p_high"),
                    ((1 - F.col("_toxic")) * (1 - F.col("_good"))).alias("p_low"), F.col("_toxic").alias("p_toxic")))


@dataclass
class Fit:
    """A multiplier for each domain (see ``rate``), the expected shares of the
    mix beside their targets, and the part of all tokens that the mix keeps."""

    weights: np.ndarray
    shares: np.ndarray
    targets: np.ndarray
    kept: float

    @property
    def met(self) -> bool:
        return bool(np.abs(self.shares - self.targets).max() <= CLOSE)


def _unbounded(weights: np.ndarray, max_rate: float) -> Column:
    return sum((F.col(f"p_{d}") * float(w) for d, w in zip(DOMAINS, weights)), F.lit(min(1.0, float(max_rate))))


def rate(weights: np.ndarray, max_rate: float) -> Column:
    """A document's rate: moved from min(1, ``max_rate``) along its posteriors
    and projected between 0 and ``max_rate``."""
    return F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), _unbounded(weights, max_rate)))


def _measure(members: DataFrame, weights: np.ndarray, max_rate: float) -> tuple[float, np.ndarray, np.ndarray]:
    """In one aggregate: the function that ``fit_rates`` brings down, the
    domains' expected tokens, and the Gram matrix of documents between the bounds."""
    top, t = float(max_rate), F.col("n_tokens").cast("double")
    x, r = _unbounded(weights, max_rate), rate(weights, max_rate)
    free = F.when((x > 0) & (x <= top), t).otherwise(0.0)
    got = members.agg(
        F.sum(t * F.when(x > top, top * x - top * top / 2).otherwise(r * r / 2)).alias("cost"),
        *(F.sum(t * F.col(f"p_{d}") * r).alias(d) for d in DOMAINS),
        *(F.sum(free * F.col(f"p_{a}") * F.col(f"p_{b}")).alias(f"{a}_{b}") for a in DOMAINS for b in DOMAINS)).first()
    return (got["cost"] or 0.0, np.array([got[d] or 0.0 for d in DOMAINS]),
            np.array([[got[f"{a}_{b}"] or 0.0 for b in DOMAINS] for a in DOMAINS]))


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE) -> Fit:
    """The least-squares rates of ``members`` whose expected shares are ``targets``.

    They have the least sum of n_tokens * (rate - min(1, ``max_rate``))**2 of all
    rates between 0 and ``max_rate`` that meet the targets, so a scarce domain
    scales the others down. They follow from one multiplier a domain: gradient
    steps, projected on the plane where the total is free and scaled by the Gram
    matrix of the documents between the bounds, each shortened until it
    descends, go on until every share is within CLOSE of its target. A step is
    one aggregate. The achieved shares are logged beside the targets.

    Where no rates but 0 meet the targets (a domain that no document belongs
    to, or posteriors that are all alike), nothing is dropped: all rates are
    min(1, ``max_rate``), with a warning. So they are, without one, for an
    empty table and one without tokens.
    """
    share = np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    plane = np.linalg.svd(share[None])[2][1:]  # directions at right angles to the targets
    nothing = np.zeros(len(DOMAINS))
    weights = nothing
    cost, total, gram = first, have, whole = _measure(members, weights, max_rate)
    if have.sum() <= 0:
        return Fit(nothing, share, share, 1.0)
    taken = 1

    def off() -> float:
        return np.abs(total / total.sum() - share).max()

    while off() > CLOSE and taken < STEPS:
        slope = plane @ total
        step = -np.linalg.solve(plane @ gram @ plane.T + 1e-9 * np.trace(whole) * np.eye(len(plane)), slope)
        size, down = 1.0, False
        while not down and taken < STEPS:
            tried = weights + size * step @ plane
            found = _measure(members, tried, max_rate)
            taken += 1
            down = found[0] <= cost * (1 + 1e-12) + 1e-4 * size * (slope @ step)
            size /= 4
        if down:
            weights, (cost, total, gram) = tried, found
        if cost <= 1e-9 * first or total.sum() <= 0:  # only rates of 0 meet the targets
            break
    kept = min(1.0, max_rate) * total.sum() / have.sum()
    if total.sum() > 0 and off() <= CLOSE:
        fit = Fit(weights, total / total.sum(), share, kept)
    else:
        fit = Fit(nothing, have / have.sum(), share, min(1.0, max_rate))
    told = ", ".join(f"{d} {a:.4f} (target {b:.4f})" for d, a, b in zip(DOMAINS, fit.shares, fit.targets))
    if fit.met:
        _log.info("mix: %s, keeping %.4f of all tokens", told, fit.kept)
    else:
        _log.warning("no rates meet the targets of the mix, all documents stay: %s", told)
    return fit


def anchor(weights: np.ndarray, targets: dict[str, float] = TARGETS) -> float:
    """What to multiply rates by so that a document wholly of the domain with
    the largest target is taken once. Shares don't change by it."""
    main = max(range(len(DOMAINS)), key=lambda k: targets[DOMAINS[k]])
    return 1 / (1 + float(weights[main])) if weights[main] > -1 else 1.0


def _copies(members: DataFrame, weights: np.ndarray, max_rate: float, scale: float = 1.0) -> DataFrame:
    """``members`` (with ``row_no``, a number of each row) with rate and copies:
    the rate rounded up or down at random, so that its expected value is the
    rate. Each row has dice of its own, also among rows of one id and text."""
    dice = F.pmod(F.xxhash64("doc_id", "row_no", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (members.withColumn("rate", rate(weights, max_rate) * scale)
            .withColumn("copies", (F.floor("rate") + (dice < F.col("rate") - F.floor("rate")).cast("int")).cast("long")))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every document; and, the
    same in all rows, the target and the achieved (expected) share of each
    domain, and whether the targets are ``met``.

    Null and empty texts have no tokens and the posteriors of the bias;
    repeated rows count and are dealt each by itself, as are rows without an id;
    an empty table gives no rows; without labels all posteriors are those of a
    bias of 0. Rows are dealt by their number in the input's partitions, so the
    same input, read the same way, is dealt the same way.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row_no"))
    members = checkpoint(posteriors(rows, fit(docs, labels), ["doc_id", "row_no"]))
    fitted = fit_rates(members, targets, max_rate)
    told = [F.lit(float(v)).alias(f"{name}_{d}") for name, values in (("target", fitted.targets), ("achieved", fitted.shares))
            for d, v in zip(DOMAINS, values)]
    return _copies(members, fitted.weights, max_rate).drop("row_no").select("*", *told, F.lit(fitted.met).alias("met"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) as often as the mix takes
    them, with all their columns: not at all, once, or more where a domain is
    scarce; those wholly of the domain with the largest target once. Null and repeated ids are dealt row by row; a null or empty text has
    no tokens and stays at the rate of its posteriors. The texts are described
    again in the pass that deals them, so they are neither joined nor exchanged."""
    models = fit(docs, labels)
    members = checkpoint(posteriors(docs.select("doc_id", "text"), models, ["doc_id"]))
    weights = fit_rates(members, targets, max_rate).weights
    scale = anchor(weights, targets)
    # the row travels as one struct, so that no column of it meets one of the mix's own
    plain = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                        F.monotonically_increasing_id().alias("row_no"))
    dealt = _copies(posteriors(plain, models, ["doc_id", "row", "row_no"]), weights, max_rate, scale).where("copies > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
