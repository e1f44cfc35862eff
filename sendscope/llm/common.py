"""Vectorised text helpers (numpy over Arrow buffers) and Spark helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that one vectorised step works on (a longer text is a step of its own).
SLICE_BYTES = 1 << 20
U = np.uint64

# Words are runs of characters other than these (fixed values of the contracts).
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
NULL_ID = np.iinfo(np.int64).max


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64), in a new array."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_POWERS = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base's powers 0..n-1 and their inverses modulo 2**64."""
    have = _POWERS.get("n", 0)
    if have < n:
        size = max(1024, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES, rows: int = 1 << 30):
    """Yield (first, end) row ranges of at most ``limit`` bytes and ``rows`` rows."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def parts(col: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30):
    """Yield (first row, end row, bytes, offsets) for each slice of a string column."""
    buf, off = text_bytes(col)
    for i, j in slices(off, limit, rows):
        yield i, j, buf[off[i]: off[j]], off[i: j + 1] - off[i]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in ``buf``, and each row's range of words."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    space = _SPACE[buf]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[off[:-1][off[:-1] < n]] = True
    last = off[1:] - 1
    after[last[last >= 0]] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of buf[start:end], equal for equal bytes."""
    up, down = powers(len(buf) + 1)
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=h[1:])
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xA0761D6478BD642F))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling (Rabin-Karp) hashes of ``size`` consecutive items that stay in
    one row: their first items and hashes, in order."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.flatnonzero(row[: n - size + 1] == row[size - 1:])
    up, down = powers(n + 1)
    g = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=g[1:])
    return first, mix((g[first + size] - g[first]) * down[first] + U(size))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


#: Labels whose rows are sampled each at a rate of its own; the rows of rarer ones share a rate.
LABELS = 1000


def bounded_sample(rows: DataFrame, key: Column, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the key.

    The rate of each label comes from its exact count, so the sample's size
    follows the parameter, not the table. Of more than LABELS labels, the rarer
    ones are sampled together, as one label.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count()
    some = counts.orderBy(F.desc("count"), label).limit(LABELS).collect()
    position = F.pmod(F.xxhash64(key), F.lit(1 << 32))

    def below(n: int) -> Column:
        return position < F.lit(int((1 << 32) * min(1.0, per_label / n)))

    keep = F.lit(False)
    for value, n in some:
        keep = keep | ((F.col(label) == F.lit(value)) & below(n))
    if len(some) == LABELS:
        rest = (counts.agg(F.sum("count")).first()[0] or 0) - sum(n for _, n in some)
        if rest:
            keep = keep | (F.col(label).isNotNull() & ~F.col(label).isin([v for v, _ in some]) & below(rest))
    return rows.where(keep)


def one_row_each(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each value of ``key``: the one with the smallest hash of the
    text. It is chosen before the rows are exchanged, so a key on a third of all
    rows is one row a task."""
    names = [c for c in rows.columns if c != key]
    least = F.min_by(F.struct(*names), F.xxhash64(*names))
    return rows.groupBy(key).agg(least.alias("_row")).select(key, "_row.*")
