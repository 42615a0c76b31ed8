"""Ids of the word vocabulary (lower case, word ends, white space dropped) in bulk.

No piece of the vocabulary spans a space or a line's end. So the texts of a batch are cut
there, each distinct word is encoded once, and the texts are put together from the words'
ids, all in Arrow and NumPy. Letters A-Z are lowered before the words are told apart, unless
the batch has a special string or characters from U+0180 on.

Words of Latin letters without control characters are cut into the vocabulary's pieces with
NumPy, all at once, and merged by tiktoken: a piece's end is a byte of its own (0x7F) that
merges with the byte before it first, as the vocabulary's word ends do. All other words,
and those with a special string, go to the ``tokenizers`` library. Both give the library's
ids (tested on whole tables, the whole vocabulary and odd texts).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END, CUT = "\x7f", "\x1e"
BATCH_BYTES = 24 << 20
#: Characters that the bulk path knows: white space, printable ASCII, Latin-1 and Latin Extended-A; the dotted capital I has no lower case of one character.
_OTHER = re.compile("[^\t-\r\x20-\x7e\x80-įı-ſ]|<\\|")
#: Bytes that may belong to other characters: control characters, those from U+0180 on, and the first of U+0100 to U+013F.
SUSPECT = np.array([b < 9 or 13 < b < 32 or b == 127 or b == 0xC4 or b > 0xC5 for b in range(256)])
_LOADED: dict[str, WordBPE] = {}


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, 4 between texts."""
    kind = {"L": 1, "N": 2}
    out = np.array([0 if chr(c) in "\t\n\x0b\x0c\r \x85\xa0" else kind.get(unicodedata.category(chr(c))[0], 3) for c in range(0x180)], np.uint8)
    out[ord(CUT)] = 4
    return out


CLASSES = _classes()
LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)


def marked(text: str) -> str:
    """The text in lower case with the end of every piece marked: white space after a piece gives way to its mark."""
    try:
        c, back = LOWER.take(np.frombuffer(text.encode("latin-1"), np.uint8)), "latin-1"
    except UnicodeEncodeError:
        c, back = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).copy(), "utf-32-le"
    kind = CLASSES.take(c)
    ends = (kind > 0) & (kind < 4)
    ends[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
    # 's 't 'm 'd 're 've 'll are pieces where the sign begins one
    at = (c == 39).nonzero()[0]
    if len(at):
        far = np.append(c, np.zeros(2, c.dtype))
        at = at[(at == 0) | (kind[at - 1] != 3)]
        one, two = far[at + 1], far[at + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        ends[at[short | long]] = False
        ends[at[short] + 1] = True
        ends[at[long] + 2] = True
    after = ends.nonzero()[0] + 1  # the last character ends a text, not a piece
    bare = kind[after] == 0
    c[after[bare]] = ord(END)
    return np.insert(c, after[~bare], ord(END)).tobytes().decode(back)


def _bytes_of_characters() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, then the rest in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordBPE:
    """Encoder for one such vocabulary, loaded once for a worker."""

    def __init__(self, name: str, end_id: int):
        import public_tokenizers
        import tiktoken

        self.path = name if os.path.sep in name else public_tokenizers.path(name)
        self.end_id, self.slow = end_id, None
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte, close = _bytes_of_characters(), model["end_of_word_suffix"]
        raw = lambda t: bytes(byte[c] for c in t.removesuffix(close)) + (END.encode() if t.endswith(close) else b"")
        ranks = {bytes([b]): b for b in range(256)}
        for b in range(256):
            ranks[bytes([b]) + END.encode()] = len(ranks)
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            ranks.setdefault(raw(a + b), len(ranks))
        ids = {raw(t): i for t, i in model["vocab"].items() if byte.keys() >= set(t.removesuffix(close))}
        self.ids = np.array([ids.get(t, 0) for t in ranks], np.uint16)
        self.ids[ord(CUT)] = end_id
        self.fast = tiktoken.Encoding("word", pat_str=f"[^\\s{END}{CUT}]+{END}|{CUT}", mergeable_ranks=ranks, special_tokens={})

    def library(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of many words without spaces in one array, with each word's first place there and number."""
        joined, odd, found = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py(), [], []
        if "<|" in joined or SUSPECT.take(np.frombuffer(joined.encode(), np.uint8)).any():
            plain = joined.split(" ")
            odd = [k for k, w in enumerate(plain) if _OTHER.search(w)]
            for k in odd:
                found.append(np.array(self.library(plain[k]), np.uint16))
                plain[k] = ""
            joined = " ".join(plain)
        ranks = self.fast.encode_to_numpy(marked(joined.replace(" ", CUT) + CUT))
        marks = ranks == ord(CUT)
        ends = marks.nonzero()[0]
        # the marks between words go, so a word's ids begin as many places earlier as there are words before it
        first = (np.concatenate(([0], ends[:-1] + 1)) - np.arange(len(ends))).astype(np.int32)
        size = (np.diff(ends, prepend=-1) - 1).astype(np.int32)
        ids = self.ids.take(ranks[~marks])
        at = len(ids)
        for k, x in zip(odd, found, strict=True):
            first[k], size[k] = at, len(x)
            at += len(x)
        return np.concatenate([ids, *found]), first, size

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with their end ids, and where each text's begin (and the last ends)."""
        texts = texts.fill_null("")
        if _lowers(texts):
            texts = pc.ascii_lower(texts)
        # line ends become spaces, so one that is a word of its own is the end of a text
        lines = pc.binary_join_element_wise(pc.replace_substring(texts, "\n", " "), pa.scalar("\n"), pa.scalar(" "))
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        ids, first, size = self.words(coded.dictionary)
        end = pc.index(coded.dictionary, "\n").as_py()
        first[end], size[end] = len(ids), 1
        ids = np.append(ids, np.uint16(self.end_id))
        word = coded.indices.to_numpy()
        n = size.take(word)
        upto = np.cumsum(n, dtype=np.int32)
        place = np.repeat(first.take(word) - upto + n, n)
        place += np.arange(len(place), dtype=np.int32)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids.take(place), np.concatenate(([0], upto))[offsets]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text, its end id last."""
        if not texts:
            return []
        ids, at = self.texts(pa.array(texts, pa.string()))
        return np.split(ids, at[1:-1])


def _lowers(texts: pa.Array) -> bool:
    """Whether A-Z may be lowered ahead of the vocabulary: not beside special strings, nor combining marks, which some small letters alone compose with."""
    data = texts.buffers()[2]
    if not len(texts) or data is None:
        return False
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    some = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return not (some.max(initial=0) > 0xC5 or pc.any(pc.match_substring(texts, "<|")).as_py())


def encoder(name: str, end_id: int) -> WordBPE:
    key = f"{name} {end_id}"
    if key not in _LOADED:
        _LOADED[key] = WordBPE(name, end_id)
    return _LOADED[key]


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """doc_id and the ids of the whole text, with the end id, as little-endian uint16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        for b in batches:
            for i, j in _slices(b.column(1)):
                ids, at = enc.texts(b.column(1).slice(i, j - i))
                col = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * 2).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), col], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about BATCH_BYTES; a longer text is one of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BATCH_BYTES, "right")))
        yield i, j
        i = j
