"""Packing by shortest-pack-first over the length histogram.

One pass encodes the texts and cuts each document into full pieces of the
context length and one remainder; only (start, length, crc) leave that pass.
The histogram of piece lengths (one count per length up to the context length)
is packed on the driver: lengths longest first, each into the packing patterns
with the most room left, pattern counts updated as they split. Every length
step splits at most one pattern group and opens at most two, so there are at
most three groups per length whatever the input. Pieces then find their pattern
by their rank among the pieces of their length; ranks come from counts per
(task, length), so no task ever sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, slices, text_bytes
from .tokens import BATCH_BYTES, Encoder

CONTEXT = 1024


def shortest_pack_first(histogram: dict[int, int], size: int = CONTEXT) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order, number of sequences) that hold every
    piece of the histogram; the lengths of a pattern sum to ``size`` at most.

    ``room[r]`` lists the pattern groups with ``r`` places left. A length goes
    to the group with the most room first, a new group when none has room.
    """
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left, placed = histogram[length], []
        r = size - 1
        while left and r >= length:
            if not room[r]:
                r -= 1
                continue
            pattern, n = room[r].pop()
            used = min(n, left)
            if n > used:
                room[r].append((pattern, n - used))
            placed.append((r - length, (*pattern, length), used))
            left -= used
        # a new group takes as many of this length as fit one behind the other
        while left:
            times = min(size // length, left)
            used = left // times
            placed.append((size - times * length, (length,) * times, used))
            left -= used * times
        for r, pattern, n in placed:
            room[r].append((pattern, n))
    return [group for r in room for group in r]


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, first sequence and offset of its slots."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            slots.setdefault(length, []).append((rank, base, offset))
            ranks[length] = rank + n
            offset += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in slots.items()}


def _pieces(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            ids, texts, (_, off) = batch.column("doc_id"), batch.column("text"), text_bytes(batch.column("text"))
            for i, j in slices(off, BATCH_BYTES):
                row, start, length, crc, total, rank = [], [], [], [], [], []
                for k, found in enumerate(encoder.ids([t or "" for t in texts.slice(i, j - i).to_pylist()]), i):
                    data = np.array([*found, 0], "<u4").tobytes()
                    n = len(found) + 1
                    for s in range(0, n, size):
                        size_here = min(size, n - s)
                        row.append(k)
                        start.append(s)
                        length.append(size_here)
                        crc.append(zlib.crc32(data[4 * s: 4 * (s + size_here)]))
                        total.append(n)
                        rank.append(seen[size_here])
                        seen[size_here] += 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                    + [pa.array([task] * len(row), pa.int64()), pa.array(rank, pa.int64())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                             "task long, task_rank long"))


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = CONTEXT) -> DataFrame:
    """Pack every document's ids, id 0 after each, into sequences of ``size``.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset. Every id lies in one piece; the pieces of a
    sequence follow each other from offset 0 without gaps. A null or empty
    text is the single id 0; repeated rows are packed each; an empty table
    gives no rows. Which of several pieces of one length takes which place
    follows the input's order, which only matters for the layout.
    """
    pieces = checkpoint(_pieces(docs, tokenizer, size))
    counts = checkpoint(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slots_of(shortest_pack_first(histogram, size))  # at most three groups of patterns per length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                ranks, first, begin = slots[int(k)]
                slot = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at], offset[at] = first[slot] + rank[at] - ranks[slot], begin[slot]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                + [pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return (pieces.join(base, ["task", "length"])
            .withColumn("rank", F.col("base") + F.col("task_rank"))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
            .mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                               "sequence_id long, offset long"))
