"""MinHash near-duplicates with an LSH forest.

Every document gets the set of its word shingles and a signature of 128
min-hashes. The forest holds several orders: in each, documents are sorted by
a permutation of the signature (a hash of the first DEPTH values, then the next
LABEL values), by ranges, so that a group of any size spreads over partitions.
Documents that share the first DEPTH values are a region, and all pairs of a
region are covered. A region larger than ``region_docs`` is divided where it
stands in the order: each part goes down to the least depth at which no more
than region_docs documents share a prefix, so the depth adapts to the region,
and each document is a candidate of its neighbours in the order, those of the
longest common prefix. That links most of a large region cheaply; the pairs it
leaves between components are then tested in tiles of the whole region (block
against block), so depth costs no recall.

Copies (equal sets) are folded first. Candidates within a region are screened
by their signatures at four and a half standard errors below the threshold,
and are confirmed on full shingle sets. Only what components need is
confirmed: a spanning forest of each large region first; then, within the
region's (or tile's) task, every pair whose ends still lie in different
components. Those pairs never leave the task, and sets come in blocks of
``block_shingles``.

Expected recall of a pair at the threshold s, in regions of any size:
1 - (1 - s ** 5) ** 24, over 0.999999 at 0.85 and 0.99992 at 0.8.

Defined cases: a document without words or with null text has an empty set
and is linked with nothing; with fewer words than a shingle, its whole
sequence is its only shingle; a null id is linked with nothing; rows that
repeat an id are one node, whatever their texts; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow_groups import runs
from sparkloom.llm.common import written
from sparkloom.llm.components import components
from sparkloom.llm.wordhash import U64, hash_words, mix, ngram_hash, row_slices, stream

SIG = 128
ORDERS = 24
DEPTH, LABEL = 5, 15
SMALL = 8
_A = (stream(3, SIG) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (stream(4, SIG) >> U64(32)).astype(np.uint32)
_PERM = np.stack([np.argsort(stream(100 + t, SIG), kind="stable") for t in range(ORDERS)])


def shingle_sets(texts, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased."""
    for i, j in row_slices(texts):
        w = hash_words(texts.slice(i, j - i), lower=True)
        grams = ngram_hash(w.hash, words, 9)
        for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    yield mix((w.hash[a:b] * stream(600 + b - a, b - a)).sum(keepdims=True, dtype=U64))
            else:
                yield np.zeros(0, U64)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(SIG, 0xFFFFFFFF, np.uint32)
    h = (s >> U64(32)).astype(np.uint32)
    for k in range(0, len(h), 2048):
        np.minimum(out, (h[k : k + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (null without shingles), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, dig, sig = [], [], []
            for s in shingle_sets(b.column(1), words):
                n.append(len(s))
                dig.append(_digest(s))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _matrix(col: pa.Array, dtype: str) -> np.ndarray:
    """Equal-length binaries as rows of a matrix."""
    data = b"".join(col.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(col), -1) if len(col) else np.zeros((0, SIG), dtype)


def _keys(sig: np.ndarray, order: int, depth: int) -> np.ndarray:
    part = sig[:, _PERM[order][:depth]].astype(U64)
    with np.errstate(over="ignore"):
        return mix((mix(part) * stream(900 + order, depth)).sum(axis=1, dtype=U64)).view(np.int64)


def _binary(m: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binaries."""
    off = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(m))])


def _entries(reps: DataFrame) -> DataFrame:
    """(tree, key, label, rep) for every order: a hash of the first DEPTH values, and a byte of each of the next LABEL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, n = _matrix(b.column(1), "<u4"), b.num_rows
            for t in range(ORDERS):
                label = (sig[:, _PERM[t][DEPTH : DEPTH + LABEL]] & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(_keys(sig, t, DEPTH)), _binary(label), b.column(0)], names=["tree", "key", "label", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "tree int, key long, label binary, rep long")


def divided(label: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """Parts (begin, end, depth) of sorted labels: each the longest run with a
    common prefix that has no more than limit rows. Rows equal to the end of
    their labels are cut every limit rows."""
    same = np.cumprod(label[1:] == label[:-1], axis=1, dtype=np.int64).sum(axis=1)  # common prefix of neighbours
    out, open_ = [], [(0, len(label), 0)]
    while open_:
        a, b, depth = open_.pop()
        if b - a <= limit:
            out.append((a, b, depth))
        elif depth == label.shape[1]:
            out += [(k, min(k + limit, b), depth) for k in range(a, b, limit)]
        else:
            cut = np.concatenate(([a], a + 1 + np.flatnonzero(same[a : b - 1] <= depth), [b]))
            open_ += [(i, j, depth + 1) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return sorted(out)


_FOUND = "tree int, key long, rep long, size int, depth int, nxt long, part int"


def _regions(entries: DataFrame, limit: int) -> DataFrame:
    """Rows of regions as the sorted order shows them in each partition.

    size: number of members (of two or more); 0 where there are more than
    limit: those rows have the next document in the order as nxt, and their
    parts' members follow at a greater depth. A region at a partition's border
    may go on in the next one, so it is kept with more than SMALL as its size,
    and rows of size -1 name the keys at both borders.
    """

    def rows(key: np.ndarray, size, depth, nxt: pa.Array | None, tree: pa.Array, rep: pa.Array) -> pa.RecordBatch:
        n, part = len(key), TaskContext.get().partitionId()
        after = pa.nulls(n, pa.int64()) if nxt is None else nxt
        full = lambda v: pa.array(np.broadcast_to(np.asarray(v, np.int32), n).copy())
        return pa.RecordBatch.from_arrays([tree, pa.array(key), rep, full(size), full(depth), after, full(part)], names=["tree", "key", "rep", "size", "depth", "nxt", "part"])

    def large(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, key, rep = _column(t, "tree"), t.column("key").to_numpy(), t.column("rep").to_numpy()
        label = _matrix(_column(t, "label"), "u1")
        nxt = pa.concat_arrays([pa.array(rep[1:]), pa.nulls(1, pa.int64())])
        yield rows(key, 0, DEPTH, nxt, tree, pa.array(rep))
        parts = np.array([p for p in divided(label, limit) if p[1] - p[0] > 1], np.int64).reshape(-1, 3)
        size = parts[:, 1] - parts[:, 0]
        at = np.repeat(parts[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())
        with np.errstate(over="ignore"):  # a key of its own for every part
            own = mix(key[parts[:, 0]].view(U64) ^ mix(rep[parts[:, 0]].view(U64) * U64(2 * LABEL + 1) + parts[:, 2].astype(U64)))
        depth = np.repeat(DEPTH + np.maximum(parts[:, 2], 1), size)
        yield rows(np.repeat(own.view(np.int64), size), np.repeat(size, size), depth, None, tree.take(pa.array(at)), pa.array(rep[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[int] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ends[1:] = [b.column(1)[b.num_rows - 1].as_py()]
                    if len(ends) == 1:
                        ends.insert(0, b.column(1)[0].as_py())
                yield b

        def give(t: pa.Table, at: np.ndarray, hot: bool, last: bool) -> Iterator[pa.RecordBatch]:
            if hot:
                yield from large(t)
                return
            key, size = t.column("key").to_numpy(), np.diff(at)
            border = key[at[:-1]] == ends[0]
            border[-1] |= last
            keep = np.repeat((size > 1) | border, size)
            if not keep.any():
                return
            size = np.repeat(np.where(border, np.maximum(size, SMALL + 1), size), size)
            t = t.filter(pa.array(keep))
            yield rows(key[keep], size[keep], DEPTH, None, _column(t, "tree"), _column(t, "rep"))

        held = None
        for now in runs(watched(), 1, limit):
            if held:
                yield from give(*held, False)
            held = now
        if held:
            yield from give(*held, True)
            k = sorted(set(ends))
            none = pa.nulls(len(k), pa.int64())
            yield rows(np.array(k), -1, DEPTH, None, pa.nulls(len(k), pa.int32()), none)

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartitionByRange(n, "key", "label").sortWithinPartitions("key", "label", "rep").mapInArrow(run, _FOUND)


def forest(reps: DataFrame, region_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of bounded regions (tree, key, rep, size, depth), pairs of
    neighbours (a, b) in those too large, and the members of these regions."""
    found = written(_regions(_entries(reps), region_docs), "forest")
    # regions that lie in several partitions; a partition has two borders, which bounds both tables
    cut = written(found.where("size = -1").groupBy("key").count().where("count > 1").select("key"), "forest-borders")
    pieces = found.where(f"size >= 0 and depth = {DEPTH}").join(F.broadcast(cut), "key").groupBy("key")
    large = written(pieces.agg(F.count("*").alias("m"), F.min("size").alias("least")).where((F.col("m") > region_docs) | (F.col("least") == 0)).select("key"), "forest-large")
    kept = found.where("size > 0")
    more = kept.where(f"depth = {DEPTH}").join(F.broadcast(large), "key", "left_semi")
    cols = ["tree", "key", "rep", "size", "depth"]
    members = kept.join(F.broadcast(large), "key", "left_anti").select(*cols)
    members = members.unionByName(more.select("tree", F.xxhash64("key", "part").alias("key"), "rep", "size", (F.col("depth") + 1).alias("depth")))
    first = found.where("size = 0").select("tree", "key", "rep").unionByName(more.select("tree", "key", "rep"))
    return members, found.where("nxt is not null").select(F.least("rep", "nxt").alias("a"), F.greatest("rep", "nxt").alias("b")), first


def _spanning(sig: np.ndarray, n: np.ndarray, least: float, share: float) -> Iterator[tuple[int, int]]:
    """A maximum spanning forest of the region's similarity graph above least (Prim)."""
    m = len(n)
    best, via, open_ = np.full(m, -1.0), np.full(m, -1), np.ones(m, bool)
    x = 0
    for _ in range(m):
        open_[x] = False
        if best[x] >= least:
            yield int(via[x]), x
        est = (sig == sig[x]).mean(axis=1)
        est[np.minimum(n, n[x]) < share * np.maximum(n, n[x])] = 0
        better = open_ & (est > best)
        best[better], via[better] = est[better], x
        left = np.where(open_, best, -2)
        x = int(left.argmax())


def _column(t: pa.Table, name: str) -> pa.Array:
    col = t.column(name)
    return col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks)


def _candidates(members: DataFrame, least: float, share: float, limit: int) -> DataFrame:
    """Candidate pairs (a < b): all that pass the screen in regions of up to
    SMALL members, and a spanning forest of larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at, _ in runs(batches, 0, limit, 20_000):
            rep, n, sig = t.column(1).to_numpy(), t.column(2).to_numpy(), _matrix(_column(t, "sig8"), "u1")
            size = np.diff(at)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            row_end = np.repeat(at[1:], size)
            small = np.repeat(size <= SMALL, size)
            for d in range(1, SMALL):
                i = np.flatnonzero(small & (np.arange(len(rep)) + d < row_end))
                if not len(i):
                    break
                j = i + d
                ok = np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                ok = (sig[i] == sig[j]).mean(axis=1) >= least
                out.append((rep[i[ok]], rep[j[ok]]))
            for g in np.flatnonzero(size > SMALL):
                a, b = at[g], at[g + 1]
                r = rep[a:b]
                e = np.array(list(_spanning(sig[a:b], n[a:b], least, share)), np.int64).reshape(-1, 2)
                out.append((r[e[:, 0]], r[e[:, 1]]))
            a, b = np.concatenate([o[0] for o in out]) if out else rep[:0], np.concatenate([o[1] for o in out]) if out else rep[:0]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    k = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select("key", "rep", "n", "sig8").repartition(k, "key").sortWithinPartitions("key", "rep").mapInArrow(run, "a long, b long").distinct()


def _partners(x: int, y: np.ndarray, n: np.ndarray, sig: np.ndarray, trees: np.ndarray, tree: int, least: float, share: float) -> np.ndarray:
    """Those of y that pass the screen with x and have not met it in an earlier tree."""
    y = y[np.minimum(n[y], n[x]) >= share * np.maximum(n[y], n[x])]
    y = y[(sig[y] == sig[x]).mean(axis=1) >= least]
    return y[~((trees[y, :tree] == trees[x, :tree]) & (trees[x, :tree] != 0)).any(axis=1)]


_OPEN = "key long, i long, j long, part long, rep long"


def _blocks(n: np.ndarray, block_shingles: int) -> np.ndarray:
    """Consecutive sets in numbered blocks of about block_shingles."""
    return np.unique((np.cumsum(n) - n) // block_shingles, return_inverse=True)[1]


def _open_batch(key: int, i: int, j: int, part: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    full = lambda v: pa.array(np.full(len(rep), v, np.int64))
    return pa.RecordBatch.from_arrays([full(key), full(i), full(j), pa.array(part.astype(np.int64)), pa.array(rep)], names=["key", "i", "j", "part", "rep"])


def _open_members(large: DataFrame, least: float, share: float, limit: int, block_shingles: int) -> DataFrame:
    """(key, i, j, part, rep): members of larger regions with a candidate in
    another component, for every tile (block i against block j) that needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at, _ in runs(batches, 0, limit, 20_000):
            key, rep, n, comp, tree = (t.column(c).to_numpy() for c in ("key", "rep", "n", "component", "tree"))
            sig = _matrix(_column(t, "sig8"), "u1")
            trees = _column(t, "trees").flatten().to_numpy().reshape(-1, ORDERS)
            for a, b in zip(at[:-1], at[1:], strict=True):
                if (comp[a:b] == comp[a]).all():
                    continue
                order = a + np.argsort(comp[a:b], kind="stable")
                end = np.searchsorted(comp[order], comp[order], "right")
                open_ = np.zeros(b - a, bool)
                for k in range(b - a):
                    if end[k] == b - a:
                        break
                    y = _partners(order[k], order[end[k] :], n, sig, trees, int(tree[a]), least, share)
                    open_[y - a] = True
                    open_[order[k] - a] |= len(y) > 0
                rows = a + np.flatnonzero(open_)
                if not len(rows):
                    continue
                block = _blocks(n[rows], block_shingles)
                i, j = np.triu_indices(block.max() + 1)
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    at_ = (block == p) | (block == q)
                    yield _open_batch(key[a], p, q, block[at_], rep[rows[at_]])

    k = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = large.select("key", "rep", "n", "component", "tree", "sig8", "trees").repartition(k, "key").sortWithinPartitions("key", "rep")
    return rows.mapInArrow(run, _OPEN)


def _region_tiles(first: DataFrame, comp: DataFrame, block_docs: int) -> DataFrame:
    """(key, i, j, part, rep): every pair of different components in a region
    too large meets in a tile, block i against block j.

    The region's largest component has blocks of its own, which need not meet
    each other: a group that already holds together is dealt only as often as
    the rest has blocks.
    """
    own = first.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    of = own.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("m")).where("most < m")
    blocks = lambda m: F.ceil(m / F.lit(block_docs)).cast("long")
    of = of.select("key", "main", blocks(F.col("m") - F.col("most")).alias("n_rest"), blocks(F.col("most")).alias("n_main"))
    is_main, h = F.col("component") == F.col("main"), F.xxhash64("rep")
    part = F.when(is_main, F.col("n_rest") + F.pmod(h, "n_main")).otherwise(F.pmod(h, "n_rest"))
    to = F.when(is_main, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_main")) - 1
    dealt = own.join(of, "key").select("key", "rep", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), to)).alias("other"))
    return dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep")


def _open_in_tiles(tiles: DataFrame, least: float, share: float, block_shingles: int) -> DataFrame:
    """As _open_members, for the tiles of regions too large."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep").combine_chunks()
        key, i, j, tree = (t.column(c)[0].as_py() for c in ("key", "i", "j", "tree"))
        part, rep, n, comp = (t.column(c).to_numpy() for c in ("part", "rep", "n", "component"))
        sig, trees = _matrix(_column(t, "sig8"), "u1"), _column(t, "trees").flatten().to_numpy().reshape(-1, ORDERS)
        open_ = np.zeros(len(rep), bool)
        xs, ys = sorted((np.flatnonzero(part == i), np.flatnonzero(part == j)), key=len)
        for k, x in enumerate(xs):
            y = ys[k + 1 :] if i == j else ys
            y = _partners(x, y[comp[y] != comp[x]], n, sig, trees, tree, least, share)
            open_[y] = True
            open_[x] |= len(y) > 0
        p, q = (np.flatnonzero(open_ & (part == b)) for b in (i, j))
        out = []
        if len(p) and len(q):
            bp, bq = _blocks(n[p], block_shingles), _blocks(n[q], block_shingles)
            for a in range(bp.max() + 1):
                for b in range(a if i == j else 0, bq.max() + 1):
                    l, r = p[bp == a], q[bq == b]  # noqa: E741
                    rows = l if i == j and a == b else np.concatenate([l, r])
                    side = np.repeat([i << 20 | a, j << 20 | b], [len(l), len(rows) - len(l)])
                    out.append(_open_batch(key, i << 20 | a, j << 20 | b, side, rep[rows]))
        return pa.Table.from_batches(out or [_open_batch(key, i, j, part[:0], rep[:0])])

    return tiles.groupBy("key", "i", "j").applyInArrow(run, _OPEN)


def _tile_links(tiles: DataFrame, least: float, share: float, percent: int, chunk: int = 1 << 20) -> DataFrame:
    """Links (a, b) that join different components within a tile, confirmed on
    full sets there: the pairs themselves never leave the task."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep").combine_chunks()
        rep, n, comp, tree, part = (t.column(c).to_numpy() for c in ("rep", "n", "component", "tree", "part"))
        across = t.column("i")[0] != t.column("j")[0]  # pairs within a block are those of its own tile
        sig, trees = _matrix(_column(t, "sig8"), "u1"), _column(t, "trees").flatten().to_numpy().reshape(-1, ORDERS)
        sets = _column(t, "s")
        off = sets.offsets.to_numpy().astype(np.int64)
        off, flat = off - off[0], sets.flatten().to_numpy()
        comp, out = comp.copy(), []
        for x in range(len(rep) - 1):
            y = np.arange(x + 1, len(rep))
            y = y[part[y] != part[x]] if across else y
            y = _partners(x, y[comp[y] != comp[x]], n, sig, trees, int(tree[0]), least, share)
            own = flat[off[x] : off[x + 1]]
            while len(y):
                m = max(1, int(np.searchsorted(np.cumsum(n[y]), chunk, "right")))
                now, y = y[:m], y[m:]
                size = off[now + 1] - off[now]
                at = np.concatenate(([0], np.cumsum(size)[:-1]))
                other = flat[np.repeat(off[now] - at, size) + np.arange(int(size.sum()))]
                hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                both = np.add.reduceat(hit.astype(np.int64), at)
                for z in now[100 * both >= percent * (len(own) + size - both)].tolist():
                    if comp[z] != comp[x]:
                        out.append((rep[x], rep[z]))
                        comp[comp == comp[z]] = comp[x]
                y = y[comp[y] != comp[x]]
        e = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(e[:, 0]), "b": pa.array(e[:, 1])})

    return tiles.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest, s: the sorted shingle set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in row_slices(b.column(1)):
                sets = list(shingle_sets(b.column(1).slice(i, j - i), words))
                dig = pa.array([_digest(x) for x in sets], pa.binary())
                sets = [np.sort(x.view(np.int64)) for x in sets]
                off = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), dig, pa.ListArray.from_arrays(off, pa.array(np.concatenate(sets)))], names=["doc_id", "digest", "s"])

    return docs.mapInArrow(run, "doc_id long, digest binary, s array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets."""
    j = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return j.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, text_col: str = "text", words: int = 5, percent: int = 80, region_docs: int = 4096, block_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    thr = percent / 100
    least = thr - 4.5 * (thr * (1 - thr) / SIG) ** 0.5
    sk = written(_sketches(base, words), "sketches")
    same = sk.where("digest is not null and doc_id is not null").groupBy("digest")
    reps = written(same.agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "reps")
    # a set's node is its smallest id, or a number where ids repeat with sets of their own, as two sets could then have one id
    shared = not reps.groupBy("id").count().where("count > 1").isEmpty()
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "reps") if shared else reps.withColumn("rep", F.col("id"))
    members, neighbours, first_depth = forest(reps.select("rep", "sig"), region_docs)

    def low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = (_matrix(b.column(2), "<u4") & 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in s], pa.binary())], names=["rep", "n", "sig8"])

    sig8 = reps.select("rep", "n", "sig").mapInArrow(low_bytes, "rep long, n long, sig8 binary")
    members = written(members.join(sig8, "rep"), "members")
    first = written(_candidates(members, least, thr, region_docs).unionByName(neighbours).distinct(), "pairs")
    wanted = first.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    if shared:
        wanted = written(reps.select("id", "digest", "rep").join(wanted, "rep", "left_semi"), "wanted")
        found = _sets(base.join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), words).join(wanted.select("digest", "rep"), "digest")
    else:
        found = _sets(base.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), words).withColumnRenamed("doc_id", "rep")
    sets = written(found.select("rep", "s").dropDuplicates(["rep"]), "sets")
    node = written(sk.select("doc_id", "n_shingles", "digest").join(reps.select("digest", "rep"), "digest", "left").drop("digest"), "nodes")
    ids = node.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    again = ids.join(node, "doc_id").select("a", F.col("rep").alias("b"))  # one id, several texts
    comp = components(written(_confirm(first, sets, percent).unionByName(again), "links"))

    def with_trees(regions: DataFrame) -> DataFrame:
        trees = regions.groupBy("rep").agg(F.array(*[F.coalesce(F.max(F.when(F.col("tree") == t, F.col("key"))), F.lit(0)) for t in range(ORDERS)]).alias("trees"))
        own = regions.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(trees, "rep").withColumn("component", F.coalesce("component", "rep"))
        return own.select("key", "rep", "n", "component", "tree", "sig8", "trees")

    large = with_trees(members.where(f"size > {SMALL} and depth = {DEPTH}"))
    open_ = _open_members(large, least, thr, region_docs, block_shingles)
    if not first_depth.isEmpty():
        tiles = written(_region_tiles(first_depth, comp, max(1, region_docs // 2)), "tiles")
        if not tiles.isEmpty():
            wide = with_trees(first_depth.join(tiles.select("key").distinct(), "key", "left_semi").join(sig8, "rep"))
            open_ = open_.unionByName(_open_in_tiles(tiles.join(wide, ["key", "rep"]), least, thr, block_shingles))
            large = large.unionByName(wide)
    open_ = written(open_, "open")
    if not open_.isEmpty():
        tiles = open_.join(large, ["key", "rep"]).join(sets, "rep")
        more = written(_tile_links(tiles, least, thr, percent), "links")
        if not more.isEmpty():
            comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = node.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    if shared:
        out = written(out.withColumn("at", F.coalesce("component", "rep")), "nodes")
        least = out.where("at is not null and doc_id is not null").groupBy("at").agg(F.min("doc_id").alias("least"))
        out = out.join(least, "at", "left").select("doc_id", "n_shingles", F.col("least").alias("component"), F.lit(None).cast("long").alias("rep"))
    comp_id = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
