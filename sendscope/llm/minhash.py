"""Document fingerprints by MinHash.

Universal hash permutations over word shingles are evaluated in vectorised
numpy. ``fingerprint`` keeps one byte per permutation; ``near_duplicates``
joins signature bands in Spark and verifies the Jaccard similarity of the
shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U, checkpoint, mix, parts, segment_hashes, windows, words
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
PERMUTATIONS, BAND = 128, 4
#: Rows that meet in one band which are compared in one tile.
TILE = 256

_KEYS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64)) >> U(32)
_A = (_KEYS[:PERMUTATIONS] | U(1)).astype(np.uint32)[:, None]
_B = _KEYS[PERMUTATIONS:].astype(np.uint32)[:, None]


def shingles_of(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word shingles and each text's range of them; a text of fewer
    words has its whole word sequence as one shingle, one without words none."""
    starts, ends, bounds = words(buf, off)
    h = segment_hashes(buf, starts, ends)
    n_words = np.diff(bounds)
    first, full = windows(h, bounds, size)
    rows, values = [np.searchsorted(bounds, first, side="right") - 1], [full]
    for n in range(1, size):
        at = np.flatnonzero(n_words == n)
        if len(at):
            short = np.zeros(len(at), np.uint64)
            for k in range(n):
                short = mix(short + h[bounds[at] + k] + U(k))
            rows.append(at)
            values.append(short)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(row, kind="stable")
    return value[order], np.searchsorted(row[order], np.arange(len(off)))


def signatures_of(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The least value of every permutation over each text's shingles (all
    ones for a text without words)."""
    value, bounds = shingles_of(buf, off, size)
    x = (value >> U(32)).astype(np.uint32)
    out = np.full((len(off) - 1, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    for i in range(len(off) - 1):
        for a in range(bounds[i], bounds[i + 1], 4096):
            np.minimum(out[i], (_A * x[a: min(a + 4096, bounds[i + 1])] + _B).min(1), out=out[i])
    return out


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """A row of PERMUTATIONS bytes for each text."""
    col = pa.array(texts, pa.large_string())
    found = [signatures_of(buf, off) for _, _, buf, off in parts(col)]
    sig = np.concatenate(found) if found else np.zeros((0, PERMUTATIONS), np.uint32)
    return (sig >> np.uint32(24) ^ sig >> np.uint32(12) ^ sig).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, corrected for bytes that agree by chance."""
    same = (a == b).mean(1)
    return np.clip((same - 1 / 256) / (255 / 256), 0, 1)


_PAIR_SCHEMA = ("doc_id long, n_chars long, edited binary, fp binary, edited_fp binary, near_edited double, "
                "near_next double, is_first boolean, is_last boolean, task long")


def _pairs(ids: list, texts: list[str], nexts: list[str], first: bool, task: int) -> pa.RecordBatch:
    """Result rows of texts whose next texts are known."""
    edited = []
    for t, n in zip(texts, nexts):
        cut = len(t) // 4
        edited.append(t[: len(t) - cut] + n[:cut])
    fp, edited_fp, next_fp = fingerprints_of(texts), fingerprints_of(edited), fingerprints_of(nexts[-1:])
    following = fp[1:]
    if len(texts):  # all but the last next text are the texts that follow
        following = np.concatenate([fp[1:], next_fp])
    n = len(texts)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
        pa.array([x.tobytes() for x in fp], pa.binary()), pa.array([x.tobytes() for x in edited_fp], pa.binary()),
        pa.array(likeness(fp, edited_fp)), pa.array(likeness(fp, following)),
        pa.array([first and k == 0 for k in range(n)], pa.bool_()), pa.array([False] * n, pa.bool_()),
        pa.array([task] * n, pa.int64())],
        ["doc_id", "n_chars", "edited", "fp", "edited_fp", "near_edited", "near_next", "is_first", "is_last", "task"])


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has the last quarter (rounded down) of its characters
    replaced by as many first characters (or all) of the next document in the
    order of doc_id, the first document following the last. Null texts are
    empty; rows of one doc_id follow each other in the order of their texts, null
    ids come last; an empty table gives no rows.

    Documents are dealt into sorted ranges of ids, so a next document is the
    next row. Only the last row of each range misses it: those, at most one per
    range, are read again together with the ranges' first documents.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first = TaskContext.get().partitionId(), True
        held_id, held = None, None
        for batch in batches:
            ids, col = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, j, _, _ in parts(col):
                texts = col.slice(i, j - i).to_pylist()
                here = ids[i:j]
                if held is not None:
                    texts, here = [held, *texts], [held_id, *here]
                if len(texts) > 1:
                    yield _pairs(here[:-1], texts[:-1], texts[1:], first, task)
                    first = False
                held_id, held = here[-1], texts[-1]
        if held is not None:
            last = _pairs([held_id], [held], [""], first, task)
            yield last.set_column(last.schema.get_field_index("is_last"), "is_last", pa.array([True]))

    done = checkpoint(rows.repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(follow, _PAIR_SCHEMA))
    # one row per range and end: bounded by the number of shuffle partitions
    ends = done.where("is_first or is_last").select("task", "doc_id", "is_first", "is_last").collect()
    begin = {r["task"]: r["doc_id"] for r in ends if r["is_first"]}
    tasks = sorted(begin)
    final = {r["task"]: r["doc_id"] for r in ends if r["is_last"]}
    follows = [(final[t], begin[tasks[(k + 1) % len(tasks)]]) for k, t in enumerate(tasks)]
    spark = docs.sparkSession
    seam = spark.createDataFrame(follows, "last_id long, next_id long")
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in {x for pair in follows for x in pair}], "end_id long"))
    texts = checkpoint(rows.join(wanted, rows.doc_id.eqNullSafe(F.col("end_id")))
                       .groupBy("end_id").agg(F.max("text").alias("last_text"), F.min("text").alias("first_text")))
    pairs = (seam.join(texts.select(F.col("end_id").alias("a"), "last_text"), F.col("last_id").eqNullSafe(F.col("a")))
             .join(texts.select(F.col("end_id").alias("b"), "first_text"), F.col("next_id").eqNullSafe(F.col("b")))
             .select("last_id", "last_text", "first_text"))

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, n in zip(*(batch.column(c).to_pylist() for c in ("last_id", "last_text", "first_text"))):
                yield _pairs([i], [t], [n], False, 0)

    return (done.where(~F.col("is_last")).unionByName(pairs.mapInArrow(join_ends, _PAIR_SCHEMA))
            .select("doc_id", "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"),
                    F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
                    "near_edited", "near_next"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every document.

    Texts that share a signature band meet; their shingle sets' Jaccard
    similarity is verified. With bands of four values a pair at 0.8 is missed
    with probability 5e-8. Equal texts are one row; a crowded band is dealt out
    as pairs of bounded salted parts, where a pair already connected in its
    tile needs no further check. Null texts are empty, wordless texts equal
    each other; repeated rows each give a row.
    """
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in parts(batch.column("text")):
                sig = signatures_of(buf, off)
                value, bounds = shingles_of(buf, off)
                sets = [np.unique(value[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
                bands = sig.reshape(len(sig), -1, BAND).astype(np.uint64)
                keys = np.full(bands.shape[:2], 7, np.uint64) + np.arange(bands.shape[1], dtype=np.uint64)
                for k in range(BAND):
                    keys = mix(keys + bands[:, :, k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(sets, pa.binary()),
                     pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64()))], ["doc_id", "shingles", "bands"])

    described = (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
                 .mapInArrow(describe, "doc_id long, shingles binary, bands array<long>")
                 .select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("shingles").alias("node"),
                         "shingles", "bands"))
    rows = checkpoint(described)
    distinct = rows.groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("first"))
    keyed = distinct.select("node", F.explode("bands").alias("key"))
    crowd = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sets = rows.groupBy("node").agg(F.first("shingles").alias("shingles"))
    met = (keyed.join(crowd, "key").withColumn("salts", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
           .withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.col("salts")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
           .select("node", "key", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"))
           .join(sets, "node"))

    def verify(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        sets_here = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        root, small, big = list(range(len(node))), [], []

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a in range(len(node)):
            for b in range(a):
                x, y = sets_here[a], sets_here[b]
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) or find(a) == find(b):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    root[find(a)] = find(b)
                    small.append(min(node[a], node[b]))
                    big.append(max(node[a], node[b]))
        return pa.table({"a": pa.array(small, pa.int64()), "b": pa.array(big, pa.int64())})

    edges = met.groupBy("key", "low", "high").applyInArrow(verify, "a long, b long").distinct()
    roots = components(edges, docs.sparkSession)
    rooted = (distinct.select("node", "first").join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
              .select("node", "first", F.coalesce("root", "node").alias("root")))
    classes = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("node", "class_id")
    no_null = [F.nullif(F.col(c), F.lit(NULL_ID)).alias(c) for c in ("doc_id", "class_id")]
    return rows.select("doc_id", "node").join(classes, "node").select(*no_null)
