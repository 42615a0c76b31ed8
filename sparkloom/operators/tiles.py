"""Scores of a block of rows against a block of questions, in NumPy: the k best of each question.

A product of matrices tells which rows may be among the k best; only these are scored anew,
summed in the order of the plain expression, so scores and their ties are the same to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.memory import give_back

#: Slack for sums in another order: far above rounding, far below any two scores that matter.
SLACK = 1e-9


def sums(products: np.ndarray) -> np.ndarray:
    """Row sums from left to right, as a fold of the elements gives them."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten(), np.float64).reshape(-1, dim)


def usable(v: Column, dim: int) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, fine)


def best(t: pa.Table, k: int, dim: int, group: int = 256) -> pa.Table:
    """The k best rows of a tile for each of its questions."""
    t = t.combine_chunks()
    is_row = t.column("is_row").to_numpy(zero_copy_only=False)
    rows, asked = t.filter(pa.array(is_row)), t.filter(pa.array(~is_row))
    v, q = matrix(rows.column("vector"), dim), matrix(asked.column("vector"), dim)
    n, picked = len(v), []
    lengths = lambda x: np.sqrt(np.concatenate([sums(x[j : j + 8192] ** 2) for j in range(0, len(x), 8192)] or [np.zeros(0)]))
    if n:
        vn, qn = lengths(v), lengths(q)
        u = v / vn[:, None]
        _, kind = np.unique(np.array(rows.column("type").to_pylist(), object).astype(str), return_inverse=True)
        ids, child = rows.column("id").to_numpy(), rows.column("child_id")
        none, child = child.is_null().to_numpy(zero_copy_only=False), child.fill_null(0).to_numpy()
        for i in range(0, len(q), group):
            near = (q[i : i + group] / qn[i : i + group, None]) @ u.T
            least = np.partition(near, n - min(k, n), axis=1)[:, n - min(k, n)]
            a, b = np.nonzero(near >= least[:, None] - SLACK)
            score = np.empty(len(a))
            for j in range(0, len(a), 8192):
                x, y = a[j : j + 8192] + i, b[j : j + 8192]
                score[j : j + 8192] = np.clip(sums(v[y] * q[x]) / (vn[y] * qn[x]), -1, 1)
            order = np.lexsort((child[b], ~none[b], ids[b], kind[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            picked.append((a[keep] + i, b[keep], score[keep]))
    a, b, score = (np.concatenate([p[j] for p in picked]) if picked else np.zeros(0, int if j < 2 else float) for j in range(3))
    return pa.table({"qid": asked.column("qid").take(pa.array(a)), **{c: rows.column(c).take(pa.array(b)) for c in ("batch", "row", "type", "id", "child_id")}, "score": pa.array(score, pa.float64())})


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.concatenate([sums(x[j : j + 8192] ** 2) for j in range(0, len(x), 8192)] or [np.zeros(0)]))


def packed(t: pa.Table) -> pa.Table:
    """A block as one row: its number, the bytes of its vectors, and every other column as a list."""
    t = t.combine_chunks()
    whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), c.combine_chunks())
    vectors = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    lists = {c: whole(t.column(c)) for c in t.column_names if c not in ("block", "vector")}
    return pa.table({"block": t.column("block").slice(0, 1), **lists, "vector": pa.array([vectors.tobytes()], pa.binary())})


class Best:
    """The k best rows so far of each question of a block; ties go by the number `row`."""

    def __init__(self, asked: np.ndarray, k: int):
        self.q, self.k, dim = asked.astype(np.float64), k, asked.shape[1]
        self.qn = lengths(self.q)
        self.unit = (self.q / self.qn[:, None]).astype(np.float32)
        # twice what single precision may lose in a product of two vectors of length 1, and as much again
        self.slack = (dim + 8) * 2.0**-22
        self.score, self.row, self.at = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), np.int64), np.zeros((len(asked), k), np.int64)

    def add(self, v: np.ndarray, row: np.ndarray, at: np.ndarray, numbers: int = 1 << 21) -> None:
        """One more block of rows, against as many questions at once as give `numbers` scores."""
        n, v = len(v), v.astype(np.float64)
        vn = lengths(v)
        u, some = (v / vn[:, None]).astype(np.float32).T, min(self.k, n)
        for i in range(0, len(self.q), step := max(1, numbers // max(1, n))):
            score, least = self.score[i : i + step], self.score[i : i + step, -1]
            near = self.unit[i : i + step] @ u
            floor = np.maximum(least, np.partition(near, n - some, axis=1)[:, n - some]) if n >= self.k and np.isneginf(least).any() else least
            a, b = np.divmod(np.flatnonzero(near >= (floor - self.slack).astype(np.float32)[:, None]), n)
            exact = np.empty(len(a))
            for j in range(0, len(a), 8192):
                x, y = a[j : j + 8192], b[j : j + 8192]
                exact[j : j + 8192] = np.clip(sums(v[y] * self.q[i + x]) / (vn[y] * self.qn[i + x]), -1, 1)
            good = exact >= least[a]
            a, b, exact = a[good], b[good], exact[good]
            if not len(a):
                continue
            # those that are there of the questions with new rows, then the new ones
            touched = np.zeros(len(score), bool)
            touched[a] = True
            x, y = np.nonzero(touched[:, None] & ~np.isneginf(score))
            a, exact = np.concatenate([x, a]), np.concatenate([score[x, y], exact])
            r, t = np.concatenate([self.row[i + x, y], row[b]]), np.concatenate([self.at[i + x, y], at[b]])
            order = np.lexsort((r, -exact, a))
            place = np.arange(len(a)) - np.searchsorted(a[order], a[order])
            order, place = order[place < self.k], place[place < self.k]
            for held, new in ((self.score, exact), (self.row, r), (self.at, t)):
                held[i + a[order], place] = new[order]


def nearest(batches: Iterator[pa.RecordBatch], k: int, dim: int, kind: str) -> Iterator[pa.RecordBatch]:
    """What one task has of the pairs of blocks: the k best of its rows for each question, once all have passed."""
    held: dict[int, tuple[Best, pa.Array, pa.Array]] = {}
    number = {"float": np.float32, "double": np.float64}[kind]
    for b in batches:
        for x in range(b.num_rows):
            of = lambda c, b=b, x=x: b.column(b.schema.get_field_index(c))[x]
            vectors = lambda c, of=of: np.frombuffer(of(c).as_buffer(), number).reshape(-1, dim)
            j = of("q_block").as_py()
            if j not in held:
                copy = lambda c: c.take(pa.array(np.arange(len(c))))
                held[j] = (Best(vectors("q_vector"), k), copy(of("_no").values), copy(of("_qid").values))
            held[j][0].add(vectors("vector"), *(of(c).values.to_numpy() for c in ("_row", "_at")))
    for best, no, qid in held.values():
        a, b = np.nonzero(~np.isneginf(best.score))
        at = pa.array(a)
        found = pa.table({"_no": no.take(at), "_qid": qid.take(at), "_row": best.row[a, b], "_at": best.at[a, b], "score": best.score[a, b]})
        yield from found.to_batches(1 << 16)
    held.clear()
    give_back()


def first(t: pa.Table, k: int) -> pa.Table:
    """The k best hits of each question, from all parts of the rows."""
    t = t.combine_chunks()
    no, score, row = (t.column(c).to_numpy() for c in ("_no", "score", "_row"))
    order = np.lexsort((row, -score, no))
    place = np.arange(len(no)) - np.searchsorted(no[order], no[order])
    return t.take(pa.array(order[place < k])).select(["_qid", "_row", "_at", "score"])
