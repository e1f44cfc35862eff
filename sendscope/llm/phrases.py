"""Phrase collocations by SON partitioning.

The corpus is dealt into a few shards (groups of input partitions). Each shard
is mined completely at the support divided by the number of shards. A phrase
that reaches the support in the whole corpus reaches that in one shard at
least, so the union of the locally frequent phrases misses none. A second pass
counts all of that union exactly.

Mining counts 64-bit hashes: phrases that share a hash are counted together, so
a hash may let a phrase too many into the union but never keeps one out. The
union travels as a bitmap of fixed size, with the same property. The second
pass counts the phrases themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, checkpoint, mix, segment_hashes, slices, text_bytes

#: Occurrences that make a phrase frequent, in the language's whole corpus.
SUPPORT = 10
#: Shards: the local support is about SUPPORT / SHARDS in each.
SHARDS = 3
#: Words of a phrase.
SHORTEST, LONGEST = 2, 3
#: A phrase gives way to a longer one with this share (in hundredths) of its count.
ABSORBED = 50
#: Bytes of text counted together in a task, and bits of the union's bitmap.
CHUNK_BYTES, BITMAP_BITS = 2 << 20, 26
#: Rows of a batch that a task hands over.
BATCH_ROWS = 1 << 15
#: Bytes of text per group of hashes, and bounds of the groups' number as a power of two.
GROUP_BYTES, GROUP_BITS = 8 << 20, (4, 20)
UNDETERMINED = "und"

# A-Z in lower case; characters that end a piece become a line feed, tabs a
# space (fixed values of the contract).
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10
_FOLD[9] = 32
_TABLE = _FOLD.tobytes()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct key occurs (once), its occurrences, and each key's number."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[begin], np.diff(np.append(begin, len(keys))), number


class Chunk:
    """The words of some texts as numbers, each with its language and piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.langs = sorted(set(langs))
        code = {v: k for k, v in enumerate(self.langs)}
        buf = b"\n".join([*texts, b""]).translate(_TABLE)
        found = buf.split()
        at = np.frombuffer(buf, np.uint8)
        gap = (at == 32) | (at == 10)
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.pieces = np.cumsum(at == 10, dtype=np.int32)[starts]
        self.words = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        self.lang = np.array([code[v] for v in langs], np.int64)[np.searchsorted(text_ends, starts, side="right")]
        self.vocabulary = list(numbers)

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from 1: where each distinct phrase (of one language)
        occurs, its language and its occurrences."""
        at, name, width = np.arange(len(self.words)), self.words + self.lang * len(self.vocabulary), max(len(self.vocabulary), 1)
        for size in range(1, LONGEST + 1):
            if size > 1:  # a shorter phrase's number and the word after it
                inside = at + size - 1 < len(self.words)
                at, name = at[inside], name[inside]
                inside = self.pieces[at] == self.pieces[at + size - 1]
                at, name = at[inside], name[inside] * width + self.words[at[inside] + size - 1]
            first, counts, name = _distinct(name)
            yield size, at[first], self.lang[at[first]], counts

    def hashes(self) -> np.ndarray:
        data = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in self.vocabulary], dtype=np.int64)
        return segment_hashes(data, ends - np.diff(ends, prepend=0), ends) if len(ends) else np.zeros(0, np.uint64)

    def hashed(self, hashes: np.ndarray, first: np.ndarray, size: int, lang: np.ndarray) -> np.ndarray:
        """64-bit hashes of phrases with their languages."""
        base = np.frombuffer("\0".join([*self.langs, ""]).encode(), np.uint8)
        ends = np.flatnonzero(base == 0)
        h = segment_hashes(base, np.concatenate([[0], ends[:-1] + 1]), ends)[lang]
        for k in range(size):
            h = mix(h * U(0x9E3779B97F4A7C15) + hashes[self.words[first + k]])
        return h


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    texts: list[bytes] = []
    langs: list[str] = []
    held = 0
    for batch in batches:
        buf, off = text_bytes(batch.column("text"))
        names = pc.fill_null(batch.column("lang"), UNDETERMINED).to_pylist()
        for i, j in slices(off, CHUNK_BYTES // 4):
            size = int(off[j] - off[i])
            if texts and held + size > CHUNK_BYTES:
                yield Chunk(texts, langs)
                texts, langs, held = [], [], 0
            texts += [buf[off[k]: off[k + 1]].tobytes() for k in range(i, j)]
            langs += names[i:j]
            held += size
    if texts:
        yield Chunk(texts, langs)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))


def mine(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, bits: int = BITMAP_BITS) -> np.ndarray:
    """The union of the locally frequent phrases: a bitmap of 2**bits bits, set
    at the top bits of their hashes.

    A shard is every ``shards``-th input partition, so a local support of
    ``support / shards`` (rounded up) in each is reached by every phrase that
    reaches ``support`` in all, however unequal the shards are. Chunks send each
    distinct phrase once, packed by the top bits of the hashes, of which 32 bits
    more are sent; a group of these counts its share of all shards and gives its
    part of the bitmap. The number of groups grows with the text.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    top = int(np.clip((size // GROUP_BYTES).bit_length(), *GROUP_BITS))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for chunk in _chunks(batches):
            hashes = chunk.hashes()
            found = [(chunk.hashed(hashes, first, size, lang), counts) for size, first, lang, counts in chunk.phrases()]
            h, c = (np.concatenate(v) for v in zip(*found))
            more = (c - 1) // 255  # a count over 255 is several entries
            h, c = np.concatenate([np.repeat(h, more), h]), np.concatenate([np.full(int(more.sum()), 255), c - 255 * more])
            order = np.argsort(h)
            h, c = h[order], c[order].astype(np.uint8)
            rest = (h << U(top) >> U(32)).astype("<u4")
            cuts = np.searchsorted(h >> U(64 - top), np.arange((1 << top) + 1).astype(np.uint64))
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            packed = [[v[cuts[g]: cuts[g + 1]].tobytes() for g in some.tolist()] for v in (rest, c)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), shard, np.int32)),
                 *(pa.array(v, pa.binary()) for v in packed)], ["grp", "shard", "hashes", "counts"])

    def frequent(table: pa.Table) -> pa.Table:
        group, of = table.column("grp")[0].as_py(), table.column("shard").to_numpy()
        part = np.zeros(1 << (bits - top), bool)
        for shard in np.unique(of):
            mine = table.filter(pa.array(of == shard))
            h = np.frombuffer(b"".join(mine.column("hashes").to_pylist()), "<u4")
            c = np.frombuffer(b"".join(mine.column("counts").to_pylist()), np.uint8)
            order = np.argsort(h)
            h = h[order]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            often = h[begin][np.add.reduceat(c[order].astype(np.int64), begin) >= -(-support // shards)]
            part[often >> np.uint32(32 - bits + top)] = True
        return pa.table({"grp": pa.array([group], pa.int32()), "part": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    sent = _plain(docs).mapInArrow(local, "grp int, shard int, hashes binary, counts binary")
    parts = sent.groupBy("grp").applyInArrow(frequent, "grp int, part binary").toArrow()
    out = np.zeros((1 << top, 1 << (bits - top - 3)), np.uint8)
    for g, part in zip(parts.column("grp").to_pylist(), parts.column("part").to_pylist()):
        out[g] = np.frombuffer(part, np.uint8)
    return out.ravel()


def count_all(docs: DataFrame, union: np.ndarray, bits: int = BITMAP_BITS) -> DataFrame:
    """lang, size, phrase and f (its exact count) of every phrase (single words
    too) whose hash the bitmap holds; as size 0 all words of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(union.tobytes())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)

        def rows(chunk: Chunk, size: int, phrases: list[str], lang: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(chunk.langs, pa.string()).take(pa.array(lang)), pa.array(np.full(len(lang), size, np.int32)),
                 pa.array(phrases, pa.string()), pa.array(counts.astype(np.int64))], ["lang", "size", "phrase", "c"])

        for chunk in _chunks(batches):
            hashes = chunk.hashes()
            yield rows(chunk, 0, [""] * len(chunk.langs), np.arange(len(chunk.langs)), np.bincount(chunk.lang, minlength=len(chunk.langs)))
            for size, first, lang, counts in chunk.phrases():
                bit = (chunk.hashed(hashes, first, size, lang) >> U(64 - bits)).astype(np.int64)
                hit = np.flatnonzero(held[bit >> 3] >> (bit & 7) & 1)
                words = [[chunk.vocabulary[w] for w in chunk.words[first[hit] + k].tolist()] for k in range(size)]
                found = rows(chunk, size, [b" ".join(w).decode("utf-8") for w in zip(*words)], lang[hit], counts[hit])
                for i in range(0, found.num_rows, BATCH_ROWS):
                    yield found.slice(i, BATCH_ROWS)

    return (_plain(docs).mapInArrow(exact, "lang string, size int, phrase string, c long")
            .groupBy("lang", "size", "phrase").agg(F.sum("c").alias("f")))


def score(counts: DataFrame, support: int = SUPPORT, absorbed: int = ABSORBED) -> DataFrame:
    """The frequent phrases of two words or more with their lowest-scoring cut:
    lang, phrase, a, l, r and score; phrases that a longer one absorbs are
    left out. Products are decimals of 38 digits, so no step overflows."""
    # every part of a frequent phrase is as frequent, so its count is at hand
    parts = (counts.where((F.col("size") > 0) & (F.col("f") >= support))
             .select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f")))
    frequent = counts.where((F.col("size") >= SHORTEST) & (F.col("f") >= support))
    split = frequent.select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))
    sides = (split.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
             .select("lang", "phrase", "a", "size", "k",
                     F.explode(F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
                                       F.struct(F.lit("r").alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("part")))).alias("s"))
             .select("lang", "phrase", "a", "size", "k", "s.*"))
    # a common word is part of a share of all phrases: both sides are dealt out
    word = F.instr("part", " ") == 0
    salted = sides.withColumn("salt", F.when(word, F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).otherwise(0).cast("int"))
    copies = parts.withColumn("salt", F.explode(F.when(word, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = salted.join(copies, ["lang", "part", "salt"])
    # a longer phrase's part of two words or more may give way to it
    # (a part of a candidate of three words is one of its two sides)
    gone = (met.where((F.instr("part", " ") > 0) & (100 * F.col("a") >= absorbed * F.col("part_f")))
            .select("lang", F.col("part").alias("phrase")).distinct())
    ratio = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) "
                   "div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    cuts = (met.groupBy("lang", "phrase", "a", "k")
            .agg(F.max(F.when(F.col("side") == "l", F.col("part_f"))).alias("l"),
                 F.max(F.when(F.col("side") == "r", F.col("part_f"))).alias("r"))
            .withColumn("score", ratio)
            .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    return (cuts.join(gone, ["lang", "phrase"], "left_anti")
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))


_SALTS = 8


def best(scored: DataFrame, limit: int = 2000) -> DataFrame:
    """Each language's first ``limit`` phrases by score, then a (both
    descending), then phrase, with their rank from 1.

    Parts of a language are cut to ``limit`` rows before they meet, so no task
    sees all phrases of one.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = scored
    for parts in (n, 4, 1):
        some = some.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)).cast("long")
        some = some.withColumn("rank", first).where(F.col("rank") <= limit).drop("part")
    return some.select("lang", "rank", "phrase", "a", "l", "r", "score")


def collocations(docs: DataFrame, support: int = SUPPORT, limit: int = 2000, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's collocations.

    Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces
    and at spaces and tabs into words. A null lang counts as ``und``; a null or
    empty text has no words; each repeated row counts; a language without a
    frequent phrase gives no rows, as does an empty table. Ties go to the larger
    count, then to the phrase that comes first in the order of UTF-8 bytes.
    """
    counts = checkpoint(count_all(docs, mine(docs, support, shards)).where((F.col("size") == 0) | (F.col("f") >= support)))
    # the languages' words meet the ranked phrases only, ``limit`` a language at most
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best(score(counts, support), limit).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
