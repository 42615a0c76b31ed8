"""Vectorised word splitting and hashing over Arrow string arrays.

A batch's texts lie in one byte buffer. Words are found with a look-up table
over the bytes; each word's 64-bit hash is a multilinear sum over its bytes,
finished with an avalanche step. No Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LUT = {}
_POW = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _table(lower: bool, seed: int) -> np.ndarray:
    if (lower, seed) not in _LUT:
        t = stream(seed + 11, 256)
        if lower:
            t[65:91] = t[97:123]
        _LUT[lower, seed] = t
    return _LUT[lower, seed]


def _powers(n: int, seed: int) -> np.ndarray:
    if len(_POW.get(seed, ())) < n:
        _POW[seed] = stream(seed + 77, max(64, 2 * n))
    return _POW[seed]


@dataclass
class Words:
    """hash: one per word; doc: word offsets of each text (n + 1);
    start, end: byte range of each word in buf."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buf: np.ndarray


def large_string(arr) -> pa.Array:
    """One contiguous large_string array with nulls as empty strings."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    return pc.fill_null(arr.cast(pa.large_string()), "")


def raw(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array (nulls: empty)."""
    arr = large_string(arr)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def hash_words(arr, lower: bool = False, seeds: tuple[int, ...] = (1,), piece: int = 1 << 20) -> Words | tuple:
    """Words and their hashes for all texts of arr.

    Work goes in pieces of whole texts of about `piece` bytes, which bounds
    the temporary arrays; a longer text is one piece. With several seeds,
    `hash` is a list with one independent hash array for each.
    """
    buf, off = raw(arr)
    hashes, starts, ends, counts = [[] for _ in seeds], [], [], []
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + piece, "right")) - 1)
        j = min(j, n)
        a, b = off[i], off[j]
        part = buf[a:b]
        solid = ~_SEP[part]
        edge = np.zeros(len(part) + 1, bool)
        cut = off[i : j + 1] - a
        edge[cut] = True
        first = solid.copy()
        if len(part):
            first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        if len(part):
            last[:-1] &= ~solid[1:] | edge[1:-1]
        s = np.flatnonzero(first)
        e = np.flatnonzero(last) + 1
        counts.append(np.diff(np.searchsorted(s, cut)))
        starts.append(s + a)
        ends.append(e + a)
        if len(s):
            size = e - s
            place = np.arange(len(part), dtype=np.int64)[solid]
            place -= np.repeat(s, size)
            data = part[solid]
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            with np.errstate(over="ignore"):
                for k, seed in enumerate(seeds):
                    v = _table(lower, seed)[data] * _powers(int(size.max()), seed)[place]
                    hashes[k].append(mix(np.add.reduceat(v, at) + size.astype(U64) * U64(0x9E3779B97F4A7C15)))
        else:
            for k in range(len(seeds)):
                hashes[k].append(np.zeros(0, U64))
        i = j
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    hs = [cat(h, U64) for h in hashes]
    doc = np.concatenate(([0], np.cumsum(cat(counts, np.int64)))).astype(np.int64)
    return Words(hs[0] if len(seeds) == 1 else hs, doc, cat(starts, np.int64), cat(ends, np.int64), buf)


def row_slices(arr, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about limit bytes; a longer row is a range of its own."""
    _, off = raw(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j
        i = j


def ngram_hash(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n values from each position on (len(h) - n + 1 of them, across texts)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    p = stream(seed + 500, n)
    with np.errstate(over="ignore"):
        out = h[:m] * p[0]
        for k in range(1, n):
            out += h[k : k + m] * p[k]
        return mix(out)


def inside(doc: np.ndarray, n: int) -> np.ndarray:
    """For n-grams from each position: whether they lie within one text."""
    total = int(doc[-1])
    m = max(0, total - n + 1)
    ok = np.zeros(total, bool)
    size = np.diff(doc)
    keep = np.maximum(size - n + 1, 0)
    a = doc[:-1][keep > 0]
    k = keep[keep > 0]
    if len(a):
        d = np.zeros(total + 1, np.int32)
        np.add.at(d, a, 1)
        np.add.at(d, a + k, -1)
        ok = np.cumsum(d[:-1]) > 0
    return ok[:m]
