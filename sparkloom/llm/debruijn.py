"""Exact substring de-duplication over a De Bruijn graph of repeated windows.

The edges of the graph are k-mers: windows of k consecutive words. A k-mer
leads from the node of its first k - 1 words to that of its last k - 1. A word
is removed if a window over it also starts earlier in the corpus (a smaller
doc_id, or the same document further left).

1. Seeds. The window's minimiser (smallest hash of its short word grams) is
   the same wherever the window occurs. Only minimisers that occur twice can
   belong to a repeated window; that leaves a fraction of the k-mers.
2. Edges. Blocks of documents emit each k-mer under a repeated seed once, with
   its node, its first place in the block and the word before it. All edges
   that leave a node meet by its hash: this gives the repeated edges with
   their source coordinates (the first place of all), and the node's degrees,
   out (different next words) and in (different words before).
3. Compaction. A node with one edge in and one out continues a path. The edge
   out of it stands one word further in the same source, so paths are read off
   the source coordinates in one sort instead of rounds of pointer joins; a
   path becomes one row a block that holds it.
4. Paths are joined back to the blocks they occur in. A window is removed
   where both its node's hash and an independent check of all its words equal
   the path's and its place is not the source's: the coordinates verify the
   span.

A block sees a k-mer once however often it holds it, so a passage in a third
of all documents costs one row a block; where more blocks hold a k-mer than a
task should hold at once, its parts go by the same source.

Defined cases: null and blank texts have no words; texts shorter than k words
lose nothing; rows that repeat a doc_id are the same place, so neither is
earlier; a null doc_id comes after all others; an empty table gives an empty
result; other columns pass through (those named n_words, n_removed, kept_text
or block are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.memory import give_back, lean
from sparkloom.llm.arrow_groups import block_count, block_of, runs
from sparkloom.llm.common import text_bytes, written
from sparkloom.llm.wordhash import U64, hash_words, inside, mix, ngram_hash, raw, row_slices

SEED_WORDS = 6
#: Bytes of text whose windows are taken at once to find seeds.
SEED_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
#: Blocks a row of repeated edges names at most.
LOT = 1024
#: In place of the hash of a word before: there are several, or none.
BRANCH = -1


def _windows(texts, k: int) -> tuple:
    """Words, positions of whole windows, and their minimisers."""
    w = hash_words(texts)
    at = np.flatnonzero(inside(w.doc, k))
    g = ngram_hash(w.hash, min(SEED_WORDS, k), 2)
    span, low = k - min(SEED_WORDS, k) + 1, g
    have = 1
    while have < span:  # sliding minimum by doubling
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return w, at, low[at]


def _edge_of(w, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The node each window leads from (64 bits of its first k - 1 words) and a check of all its words (32 bits)."""
    node = ngram_hash(w.hash, k - 1, 1)[at] if k > 1 else np.zeros(len(at), U64)
    return node, (ngram_hash(w.hash, k, 3)[at] >> U64(32)).astype(np.uint32).view(np.int32)


def _edge_key(node: np.ndarray, chk: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(node ^ (chk.view(np.uint32).astype(U64) * U64(0x9E3779B97F4A7C15)))


def _seeds(docs: DataFrame, k: int) -> DataFrame:
    """(seed, block, n): n is 2 where the seed may already cover a window twice within the batch."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches in pieces of bounded bytes: windows take ten times those of their texts."""
        for b in batches:
            for i, j in row_slices(b.column(1), SEED_BYTES):
                yield b.slice(i, j - i)
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w, at, low = _windows(b.column(1), k)
            if not len(at):
                continue
            full = ngram_hash(w.hash, k, 1)[at]
            doc = np.searchsorted(w.doc, at, "right") - 1
            block = b.column(0).to_numpy()[doc]
            first = np.ones(len(at), bool)
            first[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
            order = np.argsort(full, kind="stable")
            f = full[order]
            twice = np.zeros(len(f), bool)
            twice[1:] = f[1:] == f[:-1]
            again = order[twice]
            seed = np.concatenate([low[first], low[again]])
            blk = np.concatenate([block[first], block[again]])
            order = np.lexsort((blk, seed))
            seed, blk = seed[order], blk[order]
            start = np.concatenate(([True], (seed[1:] != seed[:-1]) | (blk[1:] != blk[:-1])))
            n = np.minimum(np.diff(np.append(np.flatnonzero(start), len(seed))), 2).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(seed[start].view(np.int64)), pa.array(blk[start].astype(np.int32)), pa.array(n)], names=["seed", "block", "n"])

    return docs.select("block", "_text").mapInArrow(run, "seed long, block int, n byte")


def _twice(seeds: DataFrame, n_blocks: int) -> DataFrame:
    """(block, seed) of the seeds that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at, hot in runs(batches, 0, 1 << 20):
            n = t.column(2).to_numpy().astype(np.int64)
            total = np.add.reduceat(n, at[:-1])
            keep = np.repeat((total > 1) | hot, np.diff(at))
            yield from t.select(["block", "seed"]).filter(pa.array(keep)).combine_chunks().to_batches()

    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seeds.repartition(parts, "seed").sortWithinPartitions("seed").mapInArrow(run, "block int, seed long")


def _ids(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return t.column("_id").to_numpy()


def _edges(docs: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Each block's distinct k-mers under repeated seeds with their first place and a mark.

    mark: 1 if the block holds the k-mer more than once, plus twice 15 bits of
    the word before it, or BRANCH in their place for several words, or none.
    """
    names = ["node", "chk", "block", "doc", "start", "mark"]

    def run(d: pa.Table, s: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())], names=names)
        if not d.num_rows or not s.num_rows:
            return empty
        w, at, low = _windows(d.column("_text"), k)
        known = np.unique(s.column("seed").to_numpy().view(np.uint64))
        at = at[known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low]
        if not len(at):
            return empty
        node, chk = _edge_of(w, at, k)
        row = np.searchsorted(w.doc, at, "right") - 1
        doc, start = _ids(d)[row], (at - w.doc[row]).astype(np.int32)
        prev = np.where(start > 0, (w.hash[np.maximum(at - 1, 0)] >> U64(49)).astype(np.int32), BRANCH)
        order = np.lexsort((start, doc, chk, node))
        node, chk, doc, start, prev = (x[order] for x in (node, chk, doc, start, prev))
        first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (chk[1:] != chk[:-1]))))
        many = np.diff(np.append(first, len(node))) > 1
        one = np.minimum.reduceat(prev, first) == np.maximum.reduceat(prev, first)
        mark = (2 * np.where(one, prev[first], BRANCH) + many).astype(np.int32)
        block = np.full(len(mark), d.column("block")[0].as_py(), np.int32)
        return pa.table([pa.array(node[first].view(np.int64)), pa.array(chk[first]), pa.array(block), pa.array(doc[first]), pa.array(start[first]), pa.array(mark)], names=names)

    return docs.select("block", "_id", "_text").groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(lean(run, 2), "node long, chk int, block int, doc long, start int, mark int")


def _repeated(edges: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """Repeated edges with source coordinates, the blocks that hold them (in
    numbered lots, one row each), and head: whether the node they leave has not
    one edge in and one out.

    Where a node's edges come in parts (more than limit rows), a k-mer goes by
    the source that its first part named, its last one in a part is kept
    whatever its number there, and all its edges are heads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # node, check, doc and start of the last k-mer of a part
        for t, _, hot in runs(batches, 0, limit):
            node, chk, block, doc, start, mark = (t.column(c).to_numpy() for c in range(6))
            n, prev = 1 + (mark & 1), mark >> 1
            at = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (chk[1:] != chk[:-1]))))
            total, size = np.add.reduceat(n.astype(np.int64), at), np.diff(np.append(at, len(node)))
            doc, start, keep = doc[at], start[at], total > 1
            if hot:
                if before and before[:2] == (node[0], chk[0]):
                    doc[0], start[0], keep[0] = before[2], before[3], True
                keep[-1] = True
                before = (node[-1], chk[-1], doc[-1], start[-1])
            at, size, doc, start = at[keep], size[keep], doc[keep], start[keep]
            if not len(at):
                continue
            rows = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
            first = np.cumsum(size) - size
            low, high = np.minimum.reduceat(prev[rows], first), np.maximum.reduceat(prev[rows], first)
            of = node[at]
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            out = np.diff(np.append(begin, len(of)))
            low, high = np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)
            head = np.repeat((out > 1) | (low != high) | (high == BRANCH) | hot, out)
            lots = -(-size // LOT)
            lot = np.arange(lots.sum()) - np.repeat(np.cumsum(lots) - lots, lots)
            off = np.append(np.repeat(first, lots) + lot * LOT, size.sum())
            each = lambda v: pa.array(np.repeat(v, lots))
            blocks = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(block[rows]))
            yield pa.RecordBatch.from_arrays([each(doc), pa.array(lot.astype(np.int32)), each(start), each(of), each(chk[at]), each(head), blocks], names=["doc", "lot", "start", "node", "chk", "head", "blocks"])

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, "node").sortWithinPartitions("node", "chk", "doc", "start").mapInArrow(run, "doc long, lot int, start int, node long, chk int, head boolean, blocks array<int>")


def _paths(edges: DataFrame) -> DataFrame:
    """Compacted paths, one row for each block they occur in: block, doc, start, nodes, chks.

    Edges are sorted by ranges of their source, so that a document of any
    length, or many without an id, spread; a path ends where a partition does.
    """
    kind = pa.schema([("block", pa.int32()), ("doc", pa.int64()), ("start", pa.int32()), ("nodes", pa.list_(pa.int64())), ("chks", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, _ in runs(batches, 0, 1 << 14, 10_000):
            t = t.combine_chunks()
            doc, lot, start = (t.column(c).to_numpy() for c in range(3))
            lists = t.column(6).chunk(0)
            off, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            size = np.diff(off)
            with np.errstate(over="ignore"):
                p = (flat.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15)
                print_ = np.add.reduceat(p ^ (p >> U64(29)), off[:-1])
            head = t.column(5).to_numpy().copy()
            head[0] = True
            head[1:] |= (doc[1:] != doc[:-1]) | (lot[1:] != lot[:-1]) | (start[1:] != start[:-1] + 1) | (size[1:] != size[:-1]) | (print_[1:] != print_[:-1])
            h = np.flatnonzero(head)
            reps = size[h]
            length = np.diff(np.append(h, len(doc)))
            # every path once for each of its blocks
            which = np.repeat(np.arange(len(h)), reps)
            within = np.arange(len(which)) - np.repeat(np.concatenate(([0], np.cumsum(reps)[:-1])), reps)
            block = flat[off[:-1][h][which] + within]
            n = length[which]
            o = np.concatenate(([0], np.cumsum(n)))
            rows = np.repeat(h[which] - o[:-1], n) + np.arange(o[-1])
            o = pa.array(o.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(doc[h][which]), pa.array(start[h][which]), pa.ListArray.from_arrays(o, pa.array(t.column(3).to_numpy()[rows])), pa.ListArray.from_arrays(o, pa.array(t.column(4).to_numpy()[rows]))],
                schema=kind,
            )

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartitionByRange(parts, "doc", "lot", "start").sortWithinPartitions("doc", "lot", "start").mapInArrow(run, "block int, doc long, start int, nodes array<long>, chks array<int>")


def _removed(texts, ids: np.ndarray, p: pa.Table, k: int) -> np.ndarray:
    """For every word of the block's texts: whether a window over it starts earlier elsewhere."""
    w = hash_words(texts)
    at = np.flatnonzero(inside(w.doc, k))
    gone = np.zeros(int(w.doc[-1]) + 1, np.int32)
    if p.num_rows and len(at):
        p = p.combine_chunks()
        lists = p.column("nodes").chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        node, chk = lists.flatten().to_numpy().view(U64), p.column("chks").chunk(0).flatten().to_numpy()
        step = np.arange(len(node)) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
        sdoc, sstart = np.repeat(p.column("doc").to_numpy(), size), np.repeat(p.column("start").to_numpy(), size) + step
        key = _edge_key(node, chk)
        order = np.argsort(key, kind="stable")
        key, node, chk, sdoc, sstart = (x[order] for x in (key, node, chk, sdoc, sstart))
        own_node, own_chk = _edge_of(w, at, k)
        full = _edge_key(own_node, own_chk)
        a = np.minimum(np.searchsorted(key, full), len(key) - 1)
        row = np.searchsorted(w.doc, at, "right") - 1
        doc, start = ids[row], at - w.doc[row]
        open_ = key[a] == full
        while True:  # edges of equal keys stand next to each other
            wrong = open_ & ((node[a] != own_node) | (chk[a] != own_chk))
            if not wrong.any():
                break
            a[wrong] += 1
            over = a >= len(key)
            a[over] = len(key) - 1
            open_ &= ~over & (key[a] == full)
        dup = at[open_ & ((doc != sdoc[a]) | (start != sstart[a]))]
        np.add.at(gone, dup, 1)
        np.add.at(gone, dup + k, -1)
    return w.doc, np.cumsum(gone[:-1]) > 0


def remove_repeats(docs: DataFrame, text_col: str = "text", words: int = 20) -> DataFrame:
    """docs with n_words, n_removed (long) and kept_text (the words left, joined by one space)."""
    n = block_count(text_bytes(docs, text_col))
    made = ("n_words", "n_removed", "kept_text", "block", "_id", "_text")
    keep = [c for c in docs.columns if c not in made]
    base = docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"))
    base = base.withColumn("block", block_of(n, "_id", text_col))
    texts = base.select("block", "_id", F.col(text_col).alias("_text"))
    seeds = written(_twice(_seeds(texts, words), n), "seeds")
    edges = written(_repeated(_edges(texts, seeds, words)), "edges")
    paths = _paths(edges)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(d: pa.Table, p: pa.Table) -> pa.Table:
        off, gone = _removed(d.column(text_col), _ids(d), p, words)
        buf, at = raw(d.column(text_col))
        buf, left = buf.tobytes(), []
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[off[1:]] - total[off[:-1]]
        for i, r in enumerate(removed.tolist()):
            ws = buf[at[i] : at[i + 1]].split()
            left.append(b" ".join(compress(ws, ~gone[off[i] : off[i + 1]]) if r else ws).decode("utf-8", "replace"))
        t = d.select(keep)
        for name, v in (("n_words", pa.array(np.diff(off))), ("n_removed", pa.array(removed.astype(np.int64))), ("kept_text", pa.array(left, pa.string()))):
            t = t.append_column(name, v)
        return t

    return base.groupBy("block").cogroup(paths.groupBy("block")).applyInArrow(lean(run, 2), schema)
