"""Token counts: batch encoding in an Arrow function that returns lengths only.

Batches hold about the same bytes. Long texts are split where a single space
stands between two non-space characters: there the tokenizer's own
pre-tokenization always starts a new unit, so the parts' ids joined are the
whole text's ids. A text holding the string of a special token is not split.

Texts for a byte-level BPE file whose merges stand in the order of their ids
are encoded by ``tiktoken`` from that file's own vocabulary, which gives the
same ids in a fifth of the time; the ``tokenizers`` library encodes for all
other files, texts with special strings, and texts with characters beyond
Latin scripts, whose classes may differ between the libraries' tables.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: Bytes of text that are encoded together.
BATCH_BYTES = 1 << 20
#: Characters from which on a text is split, and of a part at least.
LONG_TEXT = 1 << 17

_SAFE = re.compile(r"(?<=\S)(?= \S)")
_LATIN = re.compile(r"[\x00-\u024f]*")
# How byte-level tokenizers cut words (fixed value of that format).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str) -> str:
    """A file's path as it is, or a public tokenizer's by its name."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    visible Latin-1 characters stand for themselves, the others are numbered
    from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked_encoder(path: str):
    """A ``tiktoken`` encoding with the vocabulary of a byte-level BPE file, or
    None if the file is of another kind or its ids don't follow its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = model["vocab"]
    if [vocab[a + b] for a, b in merges] != [*range(256, 256 + len(merges))]:
        return None
    of = _byte_of()
    ranks = {bytes(of[c] for c in token): k for token, k in vocab.items() if k < 256 + len(merges)}
    if len(ranks) != 256 + len(merges):
        return None
    import tiktoken
    return tiktoken.Encoding("pieces", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG_TEXT) -> list[str]:
    """Parts of ``size`` characters or more that the tokenizer treats as if
    they stood in the whole text; one part if there is no safe place."""
    cuts, at = [0], size
    while at < len(text) and (found := _SAFE.search(text, at)):
        cuts.append(found.start())
        at = cuts[-1] + size
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class Encoder:
    """Ids of whole texts, without added special tokens, truncation or padding."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.ranked = ranked_encoder(tokenizer_path(name))

    def ids(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        for text in texts:
            if self.ranked is None or self.special.search(text) or not (text.isascii() or _LATIN.fullmatch(text)):
                out.append(None)
            elif len(text) <= LONG_TEXT:
                out.append(self.ranked.encode_ordinary(text))
            else:
                out.append([k for part in safe_parts(text) for k in self.ranked.encode_ordinary(part)])
        rest = [k for k, v in enumerate(out) if v is None]
        # other kinds of files may look further than the next space, so their texts stay whole
        found = self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False) if rest else []
        for k, encoding in zip(rest, found):
            out[k] = encoding.ids
        return out


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of
    every whole text. A null or empty text has 0 bytes and 0 tokens; repeated
    rows are counted each; an empty table gives no rows."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            texts, (_, off) = batch.column("text"), text_bytes(batch.column("text"))
            counts: list[int] = []
            for i, j in slices(off, BATCH_BYTES):
                counts += map(len, encoder.ids([t or "" for t in texts.slice(i, j - i).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
