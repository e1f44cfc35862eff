"""Substring dedup: repeated windows of words, by Rabin-Karp hashes.

Every window of ``WINDOW`` words gets a rolling 64-bit hash; ``first`` finds
the documents in which a smaller doc_id has the same window, and overlapping
windows merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import first
from .common import NULL_ID, checkpoint, segment_hashes, windows, words

WINDOW = 50
#: Bytes of a window's hash that are sent beside its group's bits.
WIDTH = 7


class _Windows:
    """A chunk's words and the hashes of its windows."""

    def __init__(self, chunk: first.Chunk, window: int):
        found = [], [], [], [], []
        base = 0
        for i, j in chunk.doc_slices(1 << 20):
            lo = chunk.off[i]
            buf, off = chunk.buf[lo: chunk.off[j]], chunk.off[i: j + 1] - lo
            starts, ends, bounds = words(buf, off)
            at, name = windows(segment_hashes(buf, starts, ends), bounds, window)
            for out, x in zip(found, (starts + lo, ends + lo, bounds[:-1] + base, at + base, name)):
                out.append(x)
            base += len(starts)
        join = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        self.starts, self.ends, bounds, self.at, hashes = join
        self.bounds = np.append(bounds, base)
        self.row = np.searchsorted(self.bounds, self.at, side="right") - 1
        self.names = first.Names.of(hashes.astype(np.uint64))


def _name(window: int):
    def name(batch: pa.RecordBatch, k: int, number: int, chunk: first.Chunk):
        w = _Windows(chunk, window)
        return w.names, chunk.ids[w.row[w.names.first]]
    return name


def removal(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; with
    ``carry`` also these columns and ``text``: the whole text of a document
    that loses nothing, the kept words of another.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id. Rows that share an id never remove each
    other's words; null ids come after all others. The kept words stand with
    one space between them; a null or empty text has none.
    """
    chunks = first.store(docs, carry)
    bits = first.group_bits(chunks)
    asked = first.ask(chunks, _name(window), bits, WIDTH)
    known = checkpoint(first.answers(asked, WIDTH, "later"))
    schema = (T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long")
              .add("kept_sha256", "string"))
    if carry is not None:
        schema = T.StructType([*schema.add("text", "string"), *(docs.schema[c] for c in carry)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, number, chunk in first.unpack(batch):
                w = _Windows(chunk, window)
                later = first.read_answer(batch.column("answer_0")[k], number, w.names, bits)
                owner = chunk.ids[w.row]
                gone = later[w.names.entry] | (owner > owner[w.names.first[w.names.entry]])
                edge = np.zeros(len(w.starts) + 1, np.int32)
                np.add.at(edge, w.at[gone], 1)
                np.subtract.at(edge, w.at[gone] + window, 1)
                kept = np.cumsum(edge[:-1]) == 0
                for i, j in chunk.doc_slices(1 << 20):
                    yield _results(chunk, w, kept, i, j, carry)

    answered = first.with_answers(chunks, known)
    return answered.mapInArrow(cut, schema)


def _results(chunk: first.Chunk, w: _Windows, kept: np.ndarray, i: int, j: int, carry: list[str] | None) -> pa.RecordBatch:
    lo, hi = w.bounds[i], w.bounds[j]
    keep = kept[lo:hi]
    begin, end = chunk.off[i], chunk.off[j]
    # the bytes of kept words, each followed by a space
    starts, ends = w.starts[lo:hi][keep] - begin, w.ends[lo:hi][keep] - begin
    size = ends - starts + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    last = np.cumsum(size) - 1
    body = np.ones(len(out), bool)
    body[last] = False
    inside = np.zeros(end - begin + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    out[body] = chunk.buf[begin:end][np.cumsum(inside[:-1]).astype(bool)]
    counts = np.concatenate([[0], np.cumsum(keep)])[w.bounds[i: j + 1] - lo]
    places = np.concatenate([[0], np.cumsum(size)])[counts]
    n_words = np.diff(w.bounds[i: j + 1])
    n_removed = n_words - np.diff(counts)
    sha, bodies = [], []
    for k, (a, b) in enumerate(zip(places, places[1:])):
        body_bytes = out[a: max(a, b - 1)].tobytes()
        sha.append(hashlib.sha256(body_bytes).hexdigest())
        if carry is not None:
            whole = chunk.buf[chunk.off[i + k]: chunk.off[i + k + 1]].tobytes()
            bodies.append((body_bytes if n_removed[k] else whole).decode())
    ids = chunk.ids[i:j]
    columns = [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(n_words, pa.int64()),
               pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if carry is not None:
        columns.append(pa.array(bodies, pa.string()))
        columns += [chunk.others.column(c).slice(i, j - i).combine_chunks() for c in carry]
        names += ["text", *carry]
    return pa.RecordBatch.from_arrays(columns, names)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with its own columns, repeated windows cut out of ``text``, and
    n_chars (if there is such a column) of the new text. A text that loses all
    its words stays as an empty one."""
    # the other columns travel as one struct, so that none meets one of ``removal``'s own
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")] if others else []
    kept = removal(docs.select("doc_id", "text", *row), window, ["row"] if others else [])
    of = {c: F.col("row").getField(c) for c in others}
    if "n_chars" in of:
        of["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(of["n_chars"])
    return kept.select(*(of[c].alias(c) if c in of else F.col(c) for c in docs.columns))


def window_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash, n (occurrences) and n_docs of windows found in the corpus, one row
    per distinct window: the plain count behind ``removal``, for reports."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import parts
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, buf, off in parts(batch.column("text")):
                starts, ends, bounds = words(buf, off)
                at, name = windows(segment_hashes(buf, starts, ends), bounds, window)
                row = np.searchsorted(bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ids[i + row])], ["hash", "doc_id"])

    named = (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string"))
             .mapInArrow(emit, "hash long, doc_id long"))
    per_doc = named.groupBy("hash", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))
