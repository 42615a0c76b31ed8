"""Groups of sorted Arrow batches, and blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text bytes of a block: what one grouped Arrow call holds at once.
BLOCK_BYTES = 4 << 20


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(8, -(-total_bytes // block_bytes))


def block_of(n: int, *cols: str) -> Column:
    """The block of a row by a hash of the columns. With the text among them, rows of one id (or none) spread."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def runs(batches: Iterator[pa.RecordBatch], key: int, limit: int, rows: int = 40_000) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Sorted batches as (table, group offsets, hot) with whole groups only.

    A group of more than limit rows comes in parts with hot set, so that no
    more than limit + rows rows are held.
    """
    held: list[pa.RecordBatch] = []
    n, hot = 0, None

    def give(t: pa.Table, final: bool) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
        nonlocal held, n, hot
        k = t.column(key).to_numpy()
        at = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)])) if len(k) else np.zeros(1, np.int64)
        if len(at) > 1 and hot is not None and k[0] == hot:
            yield t.slice(0, at[1]), np.array([0, at[1]]), True
            if len(at) > 2 or final:
                t, at, k = t.slice(at[1]), at[1:] - at[1], k[at[1] :]
            else:
                held, n = [], 0
                return
        if len(at) > 1 and at[-1] - at[-2] > limit and not final:
            hot = k[-1]
            yield t.slice(at[-2]), np.array([0, at[-1] - at[-2]]), True
            t, at = t.slice(0, at[-2]), at[:-1]
            held, n = [], 0
        elif not final and len(at) > 1:
            rest = t.slice(at[-2])
            held, n = rest.to_batches(), rest.num_rows
            t, at = t.slice(0, at[-2]), at[:-1]
        if len(at) > 1:
            size = np.diff(at)
            for g in np.flatnonzero(size > limit):
                yield t.slice(at[g], size[g]), np.array([0, size[g]]), True
            if (size > limit).any():
                ok = np.repeat(size <= limit, size)
                t, at = t.filter(pa.array(ok)), np.concatenate(([0], np.cumsum(size[size <= limit])))
            if len(at) > 1:
                yield t, at, False

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from give(pa.Table.from_batches(held).combine_chunks(), False)
    if held:
        yield from give(pa.Table.from_batches(held).combine_chunks(), True)
