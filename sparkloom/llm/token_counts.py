"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts longer than a chunk are cut at safe boundaries: before a single space
between two word characters. The byte-level pre-tokeniser always begins a
piece there, so the pieces of the parts are the pieces of the whole. Chunks
of all texts of an Arrow batch then form batches of about equal bytes (UTF-8),
each of which is one call of the encoder.

The ids come from the vocabulary's merge ranks; texts with the special string,
and any that the rank encoder refuses, go to the ``tokenizers`` library with
the .json file, whose results both give.

Defined cases: null is the empty text (no tokens); an empty table gives an
empty result; other columns pass through; repeated rows count alike.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS = 16_384
BATCH_BYTES = 1 << 20
SPECIAL = "<|endoftext|>"
_SAFE = re.compile(r"(?<=\w) (?=\w)")
_LOADED: dict[str, ByteBPE] = {}


class ByteBPE:
    """Encoder for one byte-level vocabulary, loaded once for a worker."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self.json = name if os.path.sep in name else public_tokenizers.path(name)
        ranks_file = re.sub(r"\.json$", ".tiktoken", self.json)
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(os.path.basename(name), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def library(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if SPECIAL in text:
            return self.library(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the extension's panics are no Exceptions
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return self.library(text)

    def batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of all texts in one call; text by text only where one is special or refused."""
        if any(SPECIAL in t for t in texts):
            return [self.ids(t) for t in texts]
        try:
            return self.fast.encode_ordinary_batch(texts, num_threads=1)
        except BaseException as e:
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return [self.ids(t) for t in texts]


def encoder(name: str) -> ByteBPE:
    if name not in _LOADED:
        _LOADED[name] = ByteBPE(name)
    return _LOADED[name]


def chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """The text in parts of about size characters, cut at safe boundaries only."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def balanced(parts: Iterable[tuple[int, str]], limit: int) -> Iterator[list[tuple[int, str]]]:
    """Batches of whole parts that are full at limit bytes of UTF-8."""
    batch, size = [], 0
    for p in parts:
        batch.append(p)
        size += len(p[1].encode("utf-8", "surrogatepass"))
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def encoded(texts: list[str | None], enc: ByteBPE, batch_bytes: int = BATCH_BYTES) -> Iterator[tuple[int, list[int]]]:
    """(place of the text, ids) of every part of every text, in order."""
    parts = ((i, c) for i, t in enumerate(texts) if t for c in chunks(t))
    for batch in balanced(parts, batch_bytes):
        yield from zip([i for i, _ in batch], enc.batch([c for _, c in batch]), strict=True)


def lengths(texts: list[str | None], enc: ByteBPE, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for i, ids in encoded(texts, enc, batch_bytes):
        out[i] += len(ids)
    return out


def count_tokens(docs: DataFrame, text_col: str = "text", out: str = "n_tokens", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """docs without the text, with the number of tokens of each whole text (long)."""
    rest = [c for c in docs.columns if c not in (text_col, out)]
    df = docs.select(*rest, F.col(text_col).alias("_text"))
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = pa.array(lengths(b.column(len(rest)).to_pylist(), enc))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(rest))] + [n], names=[*rest, out])

    return df.mapInArrow(run, schema)
