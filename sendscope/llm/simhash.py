"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are the bitwise majority of the XXH64 values of word shingles.
Equal fingerprints are one row. Two fingerprints at most ``radius`` bits apart
agree in one of ``radius + 1`` blocks of bits, and, within the rest, in one of
``radius + 1`` smaller blocks again; rows meet under those two blocks' values
only. Rows of one meeting place are compared by bit planes, and the links of a
tile leave it as a forest of links to a smallest member, never as all pairs. A
crowded meeting place is dealt out as pairs of bounded salted parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, SLICE_BYTES, U, checkpoint, parts, words
from .components import components
from .xxh import xxh64

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Rows of a meeting place that are compared in one tile.
TILE = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALL = U(0xFFFFFFFFFFFFFFFF)


def _compact(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words in lower case (A-Z), each followed by one space: the bytes, the
    words' starts and ends, and each text's range of words."""
    starts, ends, bounds = words(buf, off)
    size = ends - starts
    new_ends = np.cumsum(size + 1) - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    kept = np.ones(len(out), bool)
    kept[new_ends] = False
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.subtract.at(inside, ends, 1)
    out[kept] = _LOWER[buf[np.cumsum(inside[:-1]).astype(bool)]]
    return out, new_ends - size, new_ends, bounds


def fingerprints_of(buf: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text; 0 for a text without words."""
    text, starts, ends, bounds = _compact(buf, off)
    n_words = np.diff(bounds)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(n)), n)
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(at[-1]) - at[row] + bounds[row]
    last = np.minimum(first + shingle, bounds[row + 1]) - 1
    h = xxh64(text, starts[first], ends[last], SEED)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    for a in range(0, len(some), 64):
        rows = some[a: a + 64]
        lo, hi = at[rows[0]], at[rows[-1] + 1]
        bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[rows] - lo, axis=0, dtype=np.int64)
        major = 2 * ones > n[rows][:, None]
        out[rows] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """doc_id and fingerprint (long, the bits as a signed number) of every whole
    text, and the columns ``carry`` (longs)."""
    names = ["doc_id", *(carry or [])]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in parts(batch.column("text"), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in names), pa.array(fingerprints_of(buf, off, shingle).view(np.int64))],
                    [*names, "fp"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(carry or []))
            .mapInArrow(compute, ", ".join(f"{c} long" for c in [*names, "fp"])))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: 64 rows of packed words, bit j of plane b is bit b of value j."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide = np.zeros((64, -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view("<u8")


def near(queries: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All (query, value) positions at most ``radius`` bits apart.

    Distances of all values to a query are counted together in carry-save
    bitwise counters, one plane at a time; a value whose counter passes the
    radius is out for good, and queries that have no value left are abandoned.
    """
    vertical = planes(values)
    levels = (radius + 1).bit_length()
    alive = np.arange(len(queries))
    counters = [np.zeros((len(queries), vertical.shape[1]), np.uint64) for _ in range(levels)]
    out = np.zeros((len(queries), vertical.shape[1]), np.uint64)
    tail = len(values) % 64
    if tail:
        out[:, -1] = _ALL << U(tail)
    for b in range(64):
        flip = np.where((queries[alive] >> U(b)) & U(1), _ALL, U(0))
        carry = vertical[b][None, :] ^ flip[:, None]
        for c in counters:
            carry, c[:] = carry & c, c ^ carry
        out |= carry
        # over the radius: the counter has reached radius + 1
        reached = np.full_like(out, _ALL)
        for k, c in enumerate(counters):
            reached &= c if (radius + 1) >> k & 1 else ~c
        out |= reached
        if b % 8 == 7:
            left = (out != _ALL).any(1)
            if not left.all():
                alive, out = alive[left], out[left]
                counters = [c[left] for c in counters]
            if not len(alive):
                break
    if not len(alive):
        none = np.zeros(0, np.int64)
        return none, none
    bits = np.unpackbits((~out).view(np.uint8), axis=1, bitorder="little")[:, : len(values)]
    q, v = np.nonzero(bits)
    return alive[q], v


def _forest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every linked value to the smallest of its component."""
    root = np.arange(len(values))
    while True:  # smallest reachable position, by hooking and halving paths
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(root != np.arange(len(values)))
    return values[root[at]], values[at]


def _meeting_places(value, radius: int):
    """An array column of one key per pair of blocks in which values may agree."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    keys = []
    for k in range(n):
        low, high = cuts[k], cuts[k + 1]
        rest = [b for b in range(64) if not low <= b < high]
        inner = [len(rest) * i // n for i in range(n + 1)]
        for i in range(n):
            part = rest[inner[i]: inner[i + 1]]
            mask = sum(1 << b for b in [*range(low, high), *part])
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.xxhash64(F.lit(k * n + i), value.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are
    those of all pairs at most ``radius`` bits apart."""
    keyed = distinct.select("fp", F.explode(_meeting_places(F.col("fp"), radius)).alias("key"))
    crowd = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    salts = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    met = (keyed.join(crowd, "key").withColumn("salts", salts)
           .withColumn("salt", F.pmod(F.xxhash64("fp", F.lit("salt")), F.col("salts")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
           .select("fp", "key", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(block: np.ndarray) -> pa.RecordBatch:
            values = np.unique(block)
            a, b = near(values, values, radius)
            small, big = _forest(values, a, b)
            return pa.RecordBatch.from_arrays([pa.array(small.view(np.int64)), pa.array(big.view(np.int64))], ["a", "b"])

        held, last = np.zeros(0, np.uint64), None  # whole meeting places, compared together
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high")], 1)
            new = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            cuts = [0, *new.tolist(), len(fp)]
            begin = 0
            for k in range(len(cuts) - 1):
                starts_new = k > 0 or last is None or (place[0] != last).any()
                if starts_new and len(held) + cuts[k] - begin >= tile // 2:
                    yield linked(np.concatenate([held, fp[begin: cuts[k]]]))
                    held, begin = np.zeros(0, np.uint64), cuts[k]
            held = np.concatenate([held, fp[begin:]])
            last = place[-1] if len(place) else last
        if len(held):
            yield linked(held)

    return (met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
            .mapInArrow(compare, "a long, b long"))


def _rooted(marked: DataFrame, radius: int) -> DataFrame:
    """fp, first (the smallest doc_id with it) and root (the same for all
    fingerprints of a component) of every distinct fingerprint."""
    distinct = checkpoint(marked.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("first")))
    edges = links(distinct.select("fp"), radius).distinct()
    roots = components(edges, distinct.sparkSession)  # node, root: only for linked fingerprints
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked;
    component_id is the smallest doc_id reachable over links. Null, empty and
    wordless texts have fingerprint 0 and are linked like any other; repeated
    rows each give a row; a null id counts as the largest; an empty table gives
    no rows.
    """
    marked = checkpoint(fingerprints(docs, shingle))
    rooted = _rooted(marked, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"))
    return (marked.join(by_fp, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("component_id").cast(T.LongType())))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with exactly one row of each component: the one with the
    smallest id, null ids last, and of those that share it the one with the
    smallest hash of the text. Rows that share an id are apart unless their
    texts are near each other; which of several with one id and one text stays
    is left open."""
    names = docs.columns
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash")]
    marked = checkpoint(fingerprints(docs.select("doc_id", "text", key[1]), shingle, ["_hash"]))
    # one row a fingerprint before it meets its component: a group of copies is one row
    rows = marked.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), "_hash")).alias("least"))
    least = (rows.join(_rooted(marked, radius).select("fp", "root"), "fp")
             .groupBy("root").agg(F.min("least").alias("least")).select("least.*"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *key)
    return keyed.join(least, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("row.*")
