"""Periodic runs of words by longest common extensions over a difference cover.

A run with period q matches itself q words on. Positions on a grid of step
about 3q are enough to meet every run that has four periods; a grid position
gives a run by how far the words from it and the words q on agree to the right
and to the left. Such an extension compares a few words until both positions
lie on samples of a difference cover; only the suffixes that begin on samples
are sorted, and the minimum of their neighbours' common prefixes, from a sparse
table, is the rest of the extension.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: A run has four periods or more and six words or more (fixed values of the contract).
PERIODS, LEAST = 4, 6
#: Every difference modulo COVER is one of two members of SAMPLES (fixed values:
#: a perfect difference set).
COVER, SAMPLES = 31, np.array([1, 5, 11, 24, 25, 27])
#: Grid positions that one vectorised step looks at.
BLOCK = 1 << 19

_SAMPLED = np.zeros(COVER, bool)
_SAMPLED[SAMPLES] = True
# _SHIFT[a, b]: the least d for which a + d and b + d are both sampled residues.
_BOTH = _SAMPLED[(np.arange(COVER)[:, None, None] + np.arange(COVER)) % COVER] \
    & _SAMPLED[(np.arange(COVER)[None, :, None] + np.arange(COVER)) % COVER]
_SHIFT = _BOTH.argmax(2)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the rows of ``keys`` (most significant first), equal for equal rows."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Extensions:
    """How far the numbers of ``x`` agree from two positions on, to the right.

    Numbers are not negative; each text in ``x`` ends with a number that occurs
    once, so no common extension leaves its text.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.index: tuple[np.ndarray, np.ndarray, list[np.ndarray]] | None = None

    def _sorted_samples(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The number of each sampled position, ranks of their suffixes, and the
        sparse table of minima over neighbours' common prefixes."""
        x, v = self.x, COVER
        at = np.flatnonzero(_SAMPLED[np.arange(len(x)) % v])
        number = np.full(len(x) + 1, -1)
        number[at] = np.arange(len(at))
        padded = np.concatenate([x, np.zeros(v, x.dtype)])
        rank = np.zeros(len(at), np.int64)
        for k in range(v):  # by their first words: only ties are looked at again
            sizes = np.bincount(rank)
            tied = np.flatnonzero(sizes[rank] > 1)
            if not len(tied):
                break
            sub = _dense(rank[tied], padded[at[tied] + k])
            # ranks keep gaps of the groups' sizes, so that refining stays within a group
            order = np.argsort(sub, kind="stable")
            base = np.cumsum(sizes) - sizes
            same = rank[tied][order]
            first = np.concatenate([[True], same[1:] != same[:-1]]) if len(same) else np.zeros(0, bool)
            place = np.arange(len(order))
            place = place - place[first][np.cumsum(first) - 1]
            new = np.concatenate([[True], np.diff(sub[order]) > 0])
            place = place[np.flatnonzero(new)][np.cumsum(new) - 1]
            fresh = base[rank]
            fresh[tied[order]] = base[same] + place
            rank = fresh
        names, width = [_dense(rank)], v  # names[k]: equal if the first v * 2**k words are
        while len(at) and names[-1].max() + 1 < len(at):
            after = number[np.minimum(at + width, len(x))]
            follow = np.where(after >= 0, names[-1][after] + 1, 0)
            names.append(_dense(names[-1], follow))
            width *= 2
        rank = names[-1]
        order = np.argsort(rank)
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for k in range(len(names) - 2, -1, -1):
            i, j = number[np.minimum(a + common, len(x))], number[np.minimum(b + common, len(x))]
            same = (i >= 0) & (j >= 0)
            same[same] = names[k][i[same]] == names[k][j[same]]
            common[same] += v << k
        common += self._few(a + common, b + common, np.full(len(a), v))
        table, width = [common], 1
        while 2 * width <= len(common):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return number, rank, table

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, at most ``most``."""
        out = np.zeros(len(i), np.int64)
        left = np.flatnonzero(most > 0)
        while len(left):
            a, b = i[left] + out[left], j[left] + out[left]
            inside = np.maximum(a, b) < len(self.x)
            left, a, b = left[inside], a[inside], b[inside]
            left = left[self.x[a] == self.x[b]]
            out[left] += 1
            left = left[out[left] < most[left]]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions from ``i`` and ``j`` (``i`` is not ``j``)."""
        shift = _SHIFT[i % COVER, j % COVER]
        out = self._few(i, j, shift)
        more = np.flatnonzero(out == shift)
        more = more[np.maximum(i[more], j[more]) + shift[more] < len(self.x)]
        # most positions that reach a sample differ there at once
        more = more[self.x[i[more] + shift[more]] == self.x[j[more] + shift[more]]]
        if len(more):
            if self.index is None:
                self.index = self._sorted_samples()
            number, rank, table = self.index
            a, b = rank[number[i[more] + shift[more]]], rank[number[j[more] + shift[more]]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp(high - low)[1] - 1
            best = np.empty(len(more), np.int64)
            for k in np.unique(level):
                of = np.flatnonzero(level == k)
                best[of] = np.minimum(table[k][low[of]], table[k][high[of] - (1 << k)])
            out[more] += best
        return out


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) pairs, in blocks: for each text and period a grid that
    meets every run. ``sizes`` are the texts' words; positions count a closing
    number after each text."""
    begin = np.cumsum(sizes + 1) - sizes - 1
    periods = np.maximum(sizes // PERIODS, np.where(sizes >= LEAST, 1, 0))
    ends = np.cumsum(periods)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, BLOCK):  # (text, period) pairs by their number
        number = np.arange(a, min(a + BLOCK, total))
        text = np.searchsorted(ends, number, side="right")
        q = number - (ends - periods)[text] + 1
        step = np.maximum((PERIODS - 1) * q, LEAST - q)
        points = -(-(sizes[text] - q) // step)
        upto = np.cumsum(points)
        for b in range(0, int(upto[-1]), BLOCK):
            k = np.arange(b, min(b + BLOCK, int(upto[-1])))
            row = np.searchsorted(upto, k, side="right")
            yield begin[text[row]] + (k - (upto - points)[row]) * step[row], q[row]


def find_runs(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of the texts in ``x`` (each of
    ``sizes`` words and one closing number that occurs once), by start and period."""
    right, left = Extensions(x), Extensions(np.concatenate([x[-2::-1], [x.max() + 1]]) if len(x) else x)
    found = [np.zeros((0, 3), np.int64)]
    n = len(x) - 1  # position i of x is position n - 1 - i, read backwards
    for at, q in _grid(sizes):
        hit = x[at] == x[at + q]
        at, q = at[hit], q[hit]
        ahead = right(at, at + q)
        # a grid position in a run is followed or preceded by half of its matches
        back = left(n - at, n - at - q) if len(at) else at
        enough = ahead + back + q >= np.maximum(LEAST, PERIODS * q)
        at, q, ahead, back = at[enough], q[enough], ahead[enough], back[enough]
        found.append(np.stack([at - back, at + q + ahead, q], 1))
    runs = np.concatenate(found)
    # one row a run; a stretch that also has a shorter period is a run of that one
    order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def run_table(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, in words, by start
    and period) and collapsed (the text's words joined by one space, each run
    cut to its first period) of every whole text.

    ``rewrite`` (doc_id, words) may give other words to look at. Words are
    compared as bytes, never by a hash. A null, empty or wordless text has no
    runs and collapses to the empty text; repeated rows each give a row; a null
    doc_id stays null; an empty table gives no rows. A document is looked at in
    one task, in memory in proportion to its own length.
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in slices(off):
                texts = [buf[off[k]: off[k + 1]].tobytes().split() for k in range(i, j)]
                if rewrite:
                    texts = [rewrite(ids[i + k], w) for k, w in enumerate(texts)]
                yield _described(ids[i:j], texts)

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(compute, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"))


def _described(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
    sizes = np.array([len(w) for w in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    x = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for b, w in zip(begin.tolist(), texts):
        x[b: b + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
    x[begin + sizes] = len(numbers) + np.arange(len(texts))
    start, end, period = find_runs(x, sizes)
    depth = np.zeros(len(x) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.subtract.at(depth, end, 1)
    dropped = np.cumsum(depth) > 0
    of = np.searchsorted(begin, start, side="right") - 1
    per_text = np.searchsorted(of, np.arange(len(texts) + 1))
    collapsed = []
    for k, (b, w) in enumerate(zip(begin.tolist(), texts)):
        if per_text[k + 1] > per_text[k]:
            w = [v for v, gone in zip(w, dropped[b: b + len(w)].tolist()) if not gone]
        collapsed.append(b" ".join(w).decode("utf-8"))
    fields = [pa.array(start - begin[of], pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())]
    runs = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), runs, pa.array(collapsed, pa.string())],
                                      ["doc_id", "n_words", "runs", "collapsed"])


def digest(table: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period; nulls if there
    is none) and digests of the runs and the collapsed text of a run table."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                                  (-r["period"]).alias("period"))))
    return (table.withColumn("longest", longest)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
                    F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
                    F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
