"""Suffix-array dedup of byte strings by a distributed difference cover.

Suffixes are sampled at the positions of a perfect difference cover modulo 57:
whatever the offset between two equal strings, one pair of their positions in
the first 57 is sampled in both. Triples of 4-byte characters give the first
names; triples of names give longer names, and so on (12, 36, 108, 324 bytes;
100 bytes from three overlapping 36-byte names). As only equality of prefixes
up to 100 bytes is asked for, a name is a 64-bit hash of its triple instead of
its rank, so naming needs no exchange; names are sorted, group by group, and
neighbours compared:

1. sampled 36-byte prefixes that occur twice or more are found;
2. at those, 324-byte names that an earlier document has settle the inside of
   long repeats;
3. the remaining suffixes near the samples of step 1 are merged: their 100-byte
   prefixes are named from the samples' names and compared.

Any repeated 100-byte string holds a sampled 36-byte prefix at the same place
as its earlier copy, so step 3 misses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import first
from .common import NULL_ID, U, checkpoint, mix
from .first import Names

LENGTH = 100
# A perfect difference cover (fixed value): every nonzero difference modulo 57 occurs once.
MODULUS, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
#: Lengths of names; the first is at most LENGTH - MODULUS + 1.
SHORT, LONG = 36, 324
#: Bytes of text that are named at once, so that the arrays stay in the processor's cache.
SLICE = 1 << 17
#: Bytes of a name sent beside its group's bits: less where a false hit only costs time.
WIDTH_SHORT, WIDTH = 4, 7

_K = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _triple(names: np.ndarray, at: np.ndarray | None, steps: tuple[int, int, int]) -> np.ndarray:
    """Names of three names each: at the given positions, or at all where the last one fits."""
    n = max(len(names) - steps[2], 0)
    h = None
    for step, k in zip(steps, _K):
        part = (names[step: step + n] if at is None else names[at + step]) * k
        h = part if h is None else np.add(h, part, out=h)
    return mix(h)


def _joined(names: list[np.ndarray]) -> np.ndarray:
    """Names of three names that stand side by side."""
    h = names[0] * _K[0]
    for part, k in zip(names[1:], _K[1:]):
        h += part * k
    return mix(h)


def _names12(buf: np.ndarray) -> np.ndarray:
    if len(buf) < 12:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(buf)
    quads = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,)).astype(np.uint64)
    return _triple(quads, None, (0, 4, 8))


def _counters(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class _Text:
    """A chunk's sampled suffixes (positions in the chunk) and how far each reaches."""

    def __init__(self, chunk: first.Chunk):
        self.chunk = chunk
        size = np.diff(chunk.off)
        self.rows = np.repeat(np.arange(len(size), dtype=np.int32), size)  # of every byte
        # samples of one text: the cover, repeated as often as SHORT bytes fit
        fit = np.maximum(size - SHORT + 1, 0)
        periods = -(-fit // MODULUS)
        base = np.repeat(chunk.off[:-1], periods) + MODULUS * _counters(periods)
        at = (base[:, None] + np.array(COVER)).ravel()
        self.at = at[at <= np.repeat(chunk.off[1:] - SHORT, periods * len(COVER))]
        names = [np.zeros(0, np.uint64)]
        for i, j in chunk.doc_slices(SLICE):
            lo, hi = chunk.off[i], chunk.off[j]
            here = self.at[np.searchsorted(self.at, lo): np.searchsorted(self.at, hi)] - lo
            names.append(_triple(_names12(chunk.buf[lo:hi]), here, (0, 12, 24)))
        self.short = Names.of(np.concatenate(names))

    def row(self, at: np.ndarray) -> np.ndarray:
        return self.rows[at]

    def hits(self, answer: pa.Scalar, number: int, bits: int) -> np.ndarray:
        """Samples whose short prefix occurs again, here or in another chunk."""
        again = first.read_answer(answer, number, self.short, bits)
        times = np.bincount(self.short.entry, minlength=len(self.short.values))
        return self.at[(again | (times > 1))[self.short.entry]]

    def later(self, at: np.ndarray, names: Names, bit: np.ndarray) -> np.ndarray:
        """Whether each position's string starts earlier too: in a document
        with a smaller id, or before in the same document."""
        row = self.row(at)
        start = names.first[names.entry]
        owner = self.chunk.ids[row]
        same_row = row[start] == row
        found = bit[names.entry] | (owner > owner[start]) | (same_row & (np.arange(len(at)) > start))
        if len(np.unique(self.chunk.ids)) < len(self.chunk.ids):  # rows that share an id
            found |= _before(row, names)
        return found


def _before(row: np.ndarray, names: Names) -> np.ndarray:
    """Whether a row has had the name already."""
    order = np.lexsort((np.arange(len(row)), names.entry))
    again = np.zeros(len(row), bool)
    again[order[1:]] = (names.entry[order[1:]] == names.entry[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return again


def _long(text: _Text, hits: np.ndarray) -> tuple[np.ndarray, Names]:
    """Hits that reach LONG bytes, and their long names."""
    chunk, found, names = text.chunk, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    hits = hits[chunk.off[text.row(hits) + 1] - hits >= LONG]
    for i, j in chunk.doc_slices(SLICE):
        lo, hi = chunk.off[i], chunk.off[j]
        at = hits[np.searchsorted(hits, lo): np.searchsorted(hits, hi)] - lo
        if len(at):
            n12 = _names12(chunk.buf[lo:hi])
            n36 = [_triple(n12, at + s, (0, 12, 24)) for s in range(0, LONG, SHORT)]
            n108 = [_joined(n36[k: k + 3]) for k in (0, 3, 6)]
            found.append(at + lo)
            names.append(_joined(n108))
    return np.concatenate(found), Names.of(np.concatenate(names))


def _spread(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether each place is in [start, start + length) of any start."""
    return _inside(size, starts, np.minimum(starts + length, size))


def _inside(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each place is in any of the ranges."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


def _candidates(text: _Text, hits: np.ndarray, settled_at: np.ndarray) -> tuple[np.ndarray, Names]:
    """Windows that hold a hit's short prefix and aren't inside a long name of
    ``settled_at``, and their names."""
    chunk, found, names = text.chunk, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    settled = _spread(len(chunk.buf), settled_at, LONG - LENGTH + 1)
    back = LENGTH - SHORT
    for i, j in chunk.doc_slices(SLICE):
        lo, hi = chunk.off[i], chunk.off[j]
        at = hits[np.searchsorted(hits, lo): np.searchsorted(hits, hi)] - lo
        if not len(at):
            continue
        begin = np.maximum(at - back, chunk.off[text.row(at + lo)] - lo)
        windows = np.flatnonzero(_inside(hi - lo, begin, at + 1) & ~settled[lo:hi])
        windows = windows[windows <= chunk.off[text.row(windows + lo) + 1] - lo - LENGTH]
        n12 = _names12(chunk.buf[lo:hi])
        found.append(windows + lo)
        names.append(_joined([_triple(n12, windows + s, (0, 12, 24)) for s in (0, SHORT, LENGTH - SHORT)]))
    return np.concatenate(found), Names.of(np.concatenate(names))


def removal(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document,
    and with ``with_bytes`` the kept bytes.

    A byte goes if a LENGTH-byte string that covers it also starts earlier: in
    a document with a smaller doc_id, or before in the same document. Rows that
    share an id never remove each other's bytes; null ids come after all
    others. Texts are UTF-8 bytes, a null text is empty, and texts under LENGTH
    bytes lose nothing.
    """
    chunks = first.store(docs)
    bits = first.group_bits(chunks)

    def short(batch: pa.RecordBatch, k: int, number: int, chunk: first.Chunk):
        return _Text(chunk).short, None

    def long(batch: pa.RecordBatch, k: int, number: int, chunk: first.Chunk):
        text = _Text(chunk)
        at, names = _long(text, text.hits(batch.column("answer_0")[k], number, bits))
        return names, chunk.ids[text.row(at[names.first])]

    def settled_at(batch: pa.RecordBatch, k: int, number: int, text: _Text) -> tuple[np.ndarray, np.ndarray]:
        hits = text.hits(batch.column("answer_0")[k], number, bits)
        at, names = _long(text, hits)
        later = text.later(at, names, first.read_answer(batch.column("answer_1")[k], number, names, bits))
        return hits, at[later]

    def rest(batch: pa.RecordBatch, k: int, number: int, chunk: first.Chunk):
        text = _Text(chunk)
        at, names = _candidates(text, *settled_at(batch, k, number, text))
        return names, chunk.ids[text.row(at[names.first])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, number, chunk in first.unpack(batch):
                text = _Text(chunk)
                hits, settled = settled_at(batch, k, number, text)
                at, names = _candidates(text, hits, settled)
                later = text.later(at, names, first.read_answer(batch.column("answer_2")[k], number, names, bits))
                gone = _spread(len(chunk.buf), settled, LONG) | _spread(len(chunk.buf), at[later], LENGTH)
                yield _results(chunk, gone, with_bytes)

    again = checkpoint(first.answers(first.ask(chunks, short, bits, WIDTH_SHORT), WIDTH_SHORT, "again"))
    long_later = checkpoint(first.answers(first.ask(first.with_answers(chunks, again), long, bits, WIDTH), WIDTH, "later"))
    last = checkpoint(first.answers(first.ask(first.with_answers(chunks, again, long_later), rest, bits, WIDTH), WIDTH, "later"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return first.with_answers(chunks, again, long_later, last).mapInArrow(cut, schema)


def _results(chunk: first.Chunk, gone: np.ndarray, with_bytes: bool) -> pa.RecordBatch:
    off = chunk.off
    before = np.zeros(len(gone), bool)
    before[1:] = gone[:-1]
    inner = off[:-1][off[:-1] < len(gone)]
    before[inner] = False
    removed = np.concatenate([[0], np.cumsum(gone)])
    spans = np.concatenate([[0], np.cumsum(gone & ~before)])
    kept = chunk.buf[~gone]
    at = off - removed[off]
    bodies = [kept[a:b].tobytes() for a, b in zip(at, at[1:])]
    columns = [pa.array(chunk.ids, pa.int64(), mask=chunk.ids == NULL_ID), pa.array(np.diff(off), pa.int64()),
               pa.array(np.diff(removed[off]), pa.int64()), pa.array(np.diff(spans[off]), pa.int64()),
               pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_bytes:
        columns.append(pa.array(bodies, pa.binary()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(columns, names)
