"""Which document has a name first? A service for exact repeats at scale.

Texts are written once, in chunks of a few megabytes (compressed), as a
bucketed table in the shared folder: later passes read the same chunks in the
same order and join what they learn to them without moving a text again.

A pass computes 64-bit names (hashes of byte or word strings) in every chunk
and sends each distinct name of the chunk once, packed into one row per group
of names, in the order of the chunk's documents. Names are spread evenly over
the groups and a chunk sends a name once, however often it holds it, so a
passage that a third of all documents share is as many entries as there are
chunks. The group answers one bit per entry.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import NULL_ID, U, slices, text_bytes

#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK_BYTES = 3 << 20
#: Bytes of text per group of names, and the number of groups from which on
#: groups grow instead, up to GROUP_MOST bytes; beyond that their number grows.
GROUP_BYTES, GROUPS, GROUP_MOST = 1 << 21, (16, 4096), 1 << 26
#: Bucket keys that a writing task deals its chunks to.
KEYS = 8


@dataclass
class Chunk:
    """Documents in the order of their ids, as one byte buffer."""

    ids: np.ndarray
    buf: np.ndarray
    off: np.ndarray
    #: The other columns of the documents, if they were stored.
    others: pa.Table | None = None

    def doc_slices(self, limit: int):
        """(first, end) document ranges of at most ``limit`` bytes."""
        return slices(self.off, limit)


def _numbers(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def store(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Write doc_id, text and the columns ``carry`` as chunk rows, bucketed so
    that a join on ``key`` needs no exchange of the texts. A task writes one
    bucket's file."""
    carry = carry or []
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # keys that Spark itself hashes to each bucket: a few per bucket
    dealt = (spark.range(40 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("bucket"))
             .groupBy("bucket").agg(F.slice(F.sort_array(F.collect_list("id")), 1, KEYS).alias("keys")).collect())
    keys_of = {r["bucket"]: list(r["keys"]) for r in dealt}
    buckets = sorted(keys_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        keys = keys_of[buckets[task % len(buckets)]]
        pack = zstandard.ZstdCompressor(level=3)
        held: list[tuple[int, bytes, pa.Table]] = []
        size = made = 0

        def chunk() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            data = b"".join(t for _, t, _ in held)
            sizes = np.array([len(t) for _, t, _ in held], np.int64)
            others = None
            if carry:
                sink = pa.BufferOutputStream()
                table = pa.concat_tables([x for _, _, x in held]).combine_chunks()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                others = pack.compress(sink.getvalue().to_pybytes())
            row = [keys[made % len(keys)], (task << 32) + made, len(data), _numbers(np.array([i for i, _, _ in held], np.int64)),
                   _numbers(sizes), pack.compress(data), others]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              ["key", "chunk", "n_bytes", "ids", "sizes", "data", "others"])

        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            ids = [NULL_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            more = pa.table({c: batch.column(c) for c in carry})
            for k, i in enumerate(ids):
                text = buf[off[k]: off[k + 1]].tobytes()
                if held and size + len(text) > CHUNK_BYTES:
                    yield chunk()
                    held, size, made = [], 0, made + 1
                held.append((i, text, more.slice(k, 1)))
                size += len(text)
        if held:
            yield chunk()

    rows = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(f"`{c}`") for c in carry))
            .mapInArrow(write, "key long, chunk long, n_bytes long, ids binary, sizes binary, data binary, others binary"))
    name = f"chunks_{uuid.uuid4().hex}"
    (rows.write.format("parquet").bucketBy(n, "key").option("path", scratch_path(spark, "chunks"))
     .option("compression", "none").saveAsTable(name))
    return spark.table(name)


def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Chunk]]:
    """Row number, chunk number and chunk of each row."""
    for k in range(batch.num_rows):
        ids, sizes = (np.frombuffer(batch.column(c)[k].as_py(), "<i8") for c in ("ids", "sizes"))
        size = batch.column("n_bytes")[k].as_py()
        data = zstandard.ZstdDecompressor().decompress(batch.column("data")[k].as_py(), max_output_size=max(size, 1))
        off = np.concatenate([[0], np.cumsum(sizes)])
        others = batch.column("others")[k].as_py()
        if others is not None:
            others = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(others)).read_all()
        yield k, batch.column("chunk")[k].as_py(), Chunk(ids, np.frombuffer(data, np.uint8), off, others)


def group_bits(chunks: DataFrame) -> int:
    """The number of groups (a power of two, as its exponent) for a store."""
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    groups = max(int(np.clip(size // GROUP_BYTES, *GROUPS)), -(-size // GROUP_MOST))
    return (groups - 1).bit_length()


@dataclass
class Names:
    """The distinct names of a chunk, in the order of their first entries.

    ``entry`` gives each of the chunk's names its distinct name's number,
    ``first`` the entry that a distinct name comes from.
    """

    values: np.ndarray
    first: np.ndarray
    entry: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray) -> Names:
        order = np.argsort(names)
        ranked = names[order]
        new = np.ones(len(names), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(order, begin) if len(begin) else begin
        is_first = np.zeros(len(names), bool)
        is_first[least] = True
        number = (np.cumsum(is_first) - 1)[least]
        entry = np.empty(len(names), np.int64)
        entry[order] = np.repeat(number, np.diff(np.append(begin, len(names))))
        first = np.flatnonzero(is_first)
        return cls(names[first], first, entry)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, after that number of bytes."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unsmall(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1)


def _by_group(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The names' groups, and an order by group that keeps the names' order within each."""
    group = (values >> U(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    return group, np.argsort(group, kind="stable")


_REQUEST = "grp int, key long, chunk long, names binary, docs binary, counts binary"


def requests(key: int, chunk: int, names: Names, owner: np.ndarray | None, bits: int, width: int) -> pa.RecordBatch:
    """One row per group that the chunk has names of: ``width`` bytes of each
    name beyond the group's bits and, run by run, the ids of the ``owner`` documents."""
    group, order = _by_group(names.values, bits)
    ranked = group[order]
    rest = np.ascontiguousarray((names.values[order] << U(bits))[:, None].view(np.uint8).reshape(-1, 8)[:, 8 - width:])
    cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])) if len(ranked) else np.zeros(1, np.int64)
    owners = owner[order] if owner is not None else None
    out: list[list] = [[], [], [], []]
    for a, b in zip(cuts, cuts[1:]):
        out[0].append(int(ranked[a]))
        out[1].append(rest[a:b].tobytes())
        if owners is not None:
            mine = owners[a:b]
            runs = np.concatenate([[0], np.flatnonzero(mine[1:] != mine[:-1]) + 1])
            ids = mine[runs]
            out[2].append(_numbers(ids[:1]) + _small(np.diff(ids.astype(np.uint64))))
            out[3].append(_small(np.diff(np.append(runs, len(mine)))))
        else:
            out[2].append(None)
            out[3].append(None)
    n = len(out[0])
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int32()), pa.array([key] * n, pa.int64()), pa.array([chunk] * n, pa.int64())]
        + [pa.array(x, pa.binary()) for x in out[1:]], ["grp", "key", "chunk", "names", "docs", "counts"])


def answers(asked: DataFrame, width: int, rule: str) -> DataFrame:
    """One bit for each entry of each request, as one row per chunk.

    ``rule`` "again": another chunk has the name too. ``rule`` "later": another
    chunk has the name in a document with a smaller id.
    """
    def answer(table: pa.Table) -> pa.Table:
        packed = table.column("names").to_pylist()
        sizes = np.array([len(x) // width for x in packed], np.int64)
        raw = np.zeros((int(sizes.sum()), 8), np.uint8)
        raw[:, 8 - width:] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width)
        names = raw.view("<u8").ravel()
        if rule == "again":
            order = np.argsort(names)
            ranked = names[order]
            same = np.zeros(len(names) + 1, bool)
            same[1:-1] = ranked[1:] == ranked[:-1]
            bit = np.empty(len(names), bool)
            bit[order] = same[1:] | same[:-1]
        else:
            ids = []
            for d, c in zip(table.column("docs").to_pylist(), table.column("counts").to_pylist()):
                steps = np.concatenate([np.frombuffer(d, "<u8", 1), _unsmall(d[8:]).astype(np.uint64)])
                ids.append(np.repeat(np.cumsum(steps, dtype=np.uint64).astype(np.int64), _unsmall(c).astype(np.int64)))
            owner = np.concatenate(ids)
            order = np.argsort(names)
            ranked = names[order]
            new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            least = np.minimum.reduceat(owner[order], new)
            bit = np.empty(len(names), bool)
            bit[order] = owner[order] > np.repeat(least, np.diff(np.append(new, len(names))))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        out = [np.packbits(bit[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table({"key": table.column("key"), "chunk": table.column("chunk"), "grp": table.column("grp"),
                         "n": pa.array(sizes, pa.int32()), "bits": pa.array(out, pa.binary())})

    found = asked.groupBy("grp").applyInArrow(answer, "key long, chunk long, grp int, n int, bits binary")
    # dealt by the bucket key, as the chunks are; a row holds the answers of one chunk
    return (found.repartition("key").groupBy("key", F.col("chunk").alias("asker"))
            .agg(F.collect_list(F.struct("chunk", "grp", "n", "bits")).alias("answer")))


def with_answers(chunks: DataFrame, *rounds: DataFrame) -> DataFrame:
    """Chunk rows with the answers of earlier passes (answer_0, answer_1, ...)."""
    for k, found in enumerate(rounds):
        mine = found.select(F.col("key").alias("_key"), "asker", F.col("answer").alias(f"answer_{k}"))
        # the chunk is compared within the join on the bucket key, which needs no exchange of the chunks
        same = (F.col("key") == F.col("_key")) & (F.col("chunk") - F.col("asker") == 0)
        chunks = chunks.join(mine, same, "left").drop("_key", "asker")
    return chunks


def read_answer(cell: pa.Scalar, chunk: int, names: Names, bits: int) -> np.ndarray:
    """The answered bit of each distinct name of the chunk."""
    out = np.zeros(len(names.values), bool)
    if not cell.is_valid or not len(out):
        return out
    of, group, count, data = cell.values.flatten()  # all answers to the chunk's key
    mine = np.flatnonzero(of.to_numpy(zero_copy_only=False) == chunk)
    groups, n = (x.to_numpy(zero_copy_only=False)[mine] for x in (group, count))
    _, order = _by_group(names.values, bits)
    at = 0
    for k in np.argsort(groups):
        got = np.unpackbits(np.frombuffer(data[int(mine[k])].as_buffer(), np.uint8), count=int(n[k]))
        out[order[at: at + n[k]]] = got.astype(bool)
        at += n[k]
    if at != len(out):
        raise ValueError("answers don't fit the chunk's names")
    return out


def ask(chunks: DataFrame, name: Callable[[pa.RecordBatch, int, int, Chunk], tuple[Names, np.ndarray | None]],
        bits: int, width: int) -> DataFrame:
    """Requests of all chunks; ``name`` gives a chunk row's names and their owners."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, number, chunk in unpack(batch):
                names, owner = name(batch, k, number, chunk)
                yield requests(batch.column("key")[k].as_py(), number, names, owner, bits, width)

    return chunks.mapInArrow(send, _REQUEST)
