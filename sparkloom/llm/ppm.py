"""Prediction by partial matching over a byte-context trie, pretrained on the corpus.

A text is its words (A-Z lower-cased) joined by one space and closed by a line
end; the model codes these bytes, so its probability is that of the sequence
of tokens. Node counts of the trie: at the deepest order the number of times a
byte followed its context; below, with update exclusion, the number of longer
contexts it followed. A byte that its context has not seen costs an escape
(method D: q of q distinct symbols' half counts, q / 2T) and goes on at the
next shorter context, where the symbols already seen above are excluded; below
order 0 the remaining bytes are equally likely.

Everything excluded at one order is known from the context above it, so the
cost of a byte in its context needs five numbers and no walk over a trie in
one place:

1. Blocks of documents emit their distinct grams (context and byte) and words
   with training counts. A gram is one long.
2. Joins over grams and contexts, order by order, give each distinct gram of
   the corpus its log-probability; only grams not yet found go to the next
   order.
3. Costs are joined back to the blocks that hold the gram, and each block adds
   them up for its documents.

The tables grow with the distinct grams of the input; nothing of them passes
through the driver or a broadcast that the session's limit would not allow.

Defined cases: null and blank texts are the end token alone; whole texts are
scored; repeated rows are scored each for itself; a null doc_id counts as the
text '' for the split; without training rows all bytes are equally likely; an
empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.memory import lean
from sparkloom.llm.arrow_groups import block_count, block_of
from sparkloom.llm.common import text_bytes, written
from sparkloom.llm.wordhash import hash_words, large_string, raw

BLOCK_BYTES = 18 << 20
PIECE_BYTES = 1 << 19
#: Hash that stands for the end token among the word keys.
END = 0x5EED_0E4D
GRAM, WORD = 0, 1


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder `part`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about limit bytes; a longer row is one range."""
    off = np.concatenate(([0], np.cumsum(sizes)))
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def byte_stream(texts, depth: int) -> tuple[np.ndarray, np.ndarray, object]:
    """Grams of the coded bytes of all texts, the offsets of each text in them, and the words."""
    w = hash_words(texts, lower=True)
    buf = w.buf.copy()
    up = (buf >= 65) & (buf <= 90)
    buf[up] += 32
    size = w.end - w.start
    per_doc = np.diff(w.doc)
    cum = np.concatenate(([0], np.cumsum(size + 1)))
    coded = np.maximum(cum[w.doc[1:]] - cum[w.doc[:-1]], 1)  # bytes of each text with its line end
    off = np.concatenate(([0], np.cumsum(coded)))
    shift = depth * np.arange(1, len(per_doc) + 1)
    out = np.full(int(off[-1]) + depth * len(per_doc), 10, np.uint8)
    begin = off[:-1] + shift  # first coded byte of each text, after the padding
    if len(size):
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        at = begin[doc] + cum[:-1] - cum[w.doc[:-1]][doc]
        idx = np.arange(int(size.sum())) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
        out[np.repeat(at, size) + idx] = buf[np.repeat(w.start, size) + idx]
        sep = at + size
        sep = np.delete(sep, w.doc[1:][per_doc > 0] - 1)  # the last word's is the line end
        out[sep] = 32
    gram = np.zeros(max(0, len(out) - depth), np.int64)
    for k in range(depth + 1):
        gram <<= 8
        gram |= out[k : k + len(gram)]
    mine = np.ones(len(gram), bool)  # all but those that end in a later text's padding
    if depth:
        pad = (off[1:-1] + shift[:-1])[:, None] + np.arange(depth) - depth
        mine[pad.ravel()] = False
    return gram[mine], off, w


class Slots:
    """Distinct long keys in an open-addressed table, for many look-ups at once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(2 * len(keys) + 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        home, left, step = self._home(keys), np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            at = (home[left] + step) & (len(self.slot) - 1)
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            left, step = left[self.slot[at] != left], step + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the table's; all must be there."""
        home = self._home(keys)
        at, step = self.slot[home], 1
        off = np.flatnonzero((at < 0) | (self.keys[at] != keys))
        while len(off):
            if step > len(self.slot):
                raise KeyError("a key is not in the table")
            at[off] = self.slot[(home[off] + step) & (len(self.slot) - 1)]
            off = off[(at[off] < 0) | (self.keys[at[off]] != keys[off])]
            step += 1
        return at


def _counted(keys: np.ndarray, train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with the number of their training rows."""
    u, n = np.unique(keys[train], return_counts=True)
    rest = np.unique(keys[~train])
    return [(u, n), (rest, np.zeros(len(rest), np.int64))]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(key):
        return key, n
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def _texts(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The block's texts as one array, and their bytes."""
    arr = large_string(t.column("_text"))
    return arr, np.diff(raw(arr)[1])


def _counts(docs: DataFrame, depth: int) -> DataFrame:
    """(block, kind, key, n): distinct grams and words of each block with their training counts."""

    def run(t: pa.Table) -> pa.Table:
        arr, sizes = _texts(t)
        train = t.column("_train").to_numpy()
        found: dict[int, list] = {GRAM: [], WORD: []}
        for i, j in pieces(sizes, PIECE_BYTES):
            gram, off, w = byte_stream(arr.slice(i, j - i), depth)
            part = train[i:j]
            found[GRAM] += _counted(gram, np.repeat(part, np.diff(off)))
            found[WORD] += _counted(w.hash.view(np.int64), np.repeat(part, np.diff(w.doc)))
            for f in found.values():
                if len(f) >= 8:
                    f[:] = [_merge(f)]
        found[WORD].append((np.array([END]), np.array([int(train.sum())])))
        block, out = t.column("block")[0].as_py(), []
        for kind in (GRAM, WORD):
            key, n = _merge(found[kind])
            out.append(pa.table({"block": pa.array(np.full(len(key), block, np.int32)), "kind": pa.array(np.full(len(key), kind, np.int8)), "key": pa.array(key), "n": pa.array(n)}))
        return pa.concat_tables(out)

    return docs.groupBy("block").applyInArrow(lean(run), "block int, kind byte, key long, n long")


def _contexts(grams: DataFrame, shorter: DataFrame | None, depth: int) -> DataFrame:
    """ctx, t (count), q (symbols) and e (their counts one order below) of an order's contexts."""
    ctx = F.shiftright("key", 8)
    if shorter is None:
        return grams.groupBy(ctx.alias("ctx")).agg(F.sum("c").alias("t"), F.count("*").alias("q"), F.lit(0).cast("long").alias("e"))
    low = shorter.select(F.col("key").alias("low"), F.col("c").alias("below"))
    j = grams.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << 8 * depth) - 1))).join(low, "low")
    return j.groupBy(ctx.alias("ctx")).agg(F.sum("c").alias("t"), F.count("*").alias("q"), F.sum("below").alias("e"))


def gram_costs(counts: DataFrame, depth: int) -> DataFrame:
    """(key, c) of all distinct grams -> (key, lp): natural log-probability of the byte in its context.

    c is 0 for grams that training texts do not hold.
    """
    seen = [None] * (depth + 1)
    seen[depth] = counts.where("c > 0")
    for k in range(depth - 1, -1, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")
        seen[k] = written(seen[k + 1].select(low).groupBy("key").agg(F.count("*").alias("c")), "ppm-trie")
    ctxs = [written(_contexts(seen[k], seen[k - 1] if k else None, k), "ppm-contexts") for k in range(depth + 1)]
    ctx = F.shiftright("low", 8).alias("ctx")
    cost = lambda c, r: F.log((2 * F.col(c) - 1) / (2 * r))
    top = counts.select("key", F.col("key").alias("low"), "c").withColumn("ctx", F.shiftright("low", 8)).join(ctxs[depth], "ctx", "left")
    done = [top.where("c > 0").select("key", cost("c", F.col("t")).alias("lp"))]
    q, t = F.coalesce("q", F.lit(0)), F.coalesce("t", F.lit(0))
    open_ = written(top.where("c = 0").select("key", "low", F.when(q > 0, F.log(q / (2 * t))).otherwise(0.0).alias("acc"), F.coalesce("e", F.lit(0)).alias("e0"), q.alias("q0")), "ppm-escape")
    for k in range(depth - 1, -1, -1):
        rows = open_.withColumn("low", F.col("low").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)))
        rows = rows.join(seen[k].select(F.col("key").alias("low"), "c"), "low", "left")
        rows = rows.select("*", ctx).join(ctxs[k], "ctx", "left")
        r, left = t - F.col("e0"), q - F.col("q0")
        done.append(rows.where("c is not null").select("key", (F.col("acc") + cost("c", r)).alias("lp")))
        esc = F.when(left > 0, F.log(left / (2 * r))).otherwise(0.0)
        open_ = written(rows.where("c is null").select("key", "low", (F.col("acc") + esc).alias("acc"), F.coalesce("e", F.lit(0)).alias("e0"), q.alias("q0")), "ppm-escape")
    done.append(open_.select("key", (F.col("acc") - F.log(256.0 - F.col("q0"))).alias("lp")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def score(docs: DataFrame, train: Column, text_col: str = "text", depth: int = 5) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score (unigrams with add-one), score (both log10).

    train tells the rows to learn from; depth is the longest context in bytes (6 at most).
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must lie between 1 and 6")
    n = block_count(text_bytes(docs, text_col), BLOCK_BYTES)
    base = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    base = base.withColumn("block", block_of(n, "doc_id", "_text"))
    counts = written(_counts(base, depth), "ppm-counts")
    words = written(counts.where(f"kind = {WORD}").groupBy("key").agg(F.sum("n").alias("c")), "ppm-words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    grams = written(counts.where(f"kind = {GRAM}").groupBy("key").agg(F.sum("n").alias("c")), "ppm-grams")
    costs = gram_costs(grams, depth).select(F.lit(GRAM).cast("byte").alias("kind"), "key", F.col("lp").alias("v"))
    costs = costs.unionByName(words.select(F.lit(WORD).cast("byte").alias("kind"), "key", F.col("c").cast("double").alias("v")))
    per_block = counts.select("block", "kind", "key").join(costs, ["kind", "key"])
    floor = np.log10(total + distinct + 1)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(d: pa.Table, c: pa.Table) -> pa.Table:
        arr, sizes = _texts(d)
        kind, key, v = (c.column(x).to_numpy() for x in ("kind", "key", "v"))
        grams, gram_v = Slots(key[kind == GRAM]), v[kind == GRAM]
        words, word_v = Slots(key[kind == WORD]), v[kind == WORD]
        ends = word_v[words.find(np.array([END]))][0] if len(arr) else 0.0
        cols: list[list[np.ndarray]] = [[], [], [], []]
        add = lambda x, off: np.diff(np.concatenate(([0.0], np.cumsum(x)))[off])
        for i, j in pieces(sizes, PIECE_BYTES):
            gram, off, w = byte_stream(arr.slice(i, j - i), depth)
            lp = gram_v[grams.find(gram)]
            cw = word_v[words.find(w.hash.view(np.int64))]
            cols[0].append(np.diff(w.doc) + 1)
            cols[1].append(np.rint(add((cw > 0).astype(float), w.doc)).astype(np.int64) + int(ends > 0))
            cols[2].append(add(np.log10(cw + 1) - floor, w.doc) + np.log10(ends + 1) - floor)
            cols[3].append(np.add.reduceat(lp, off[:-1]) / np.log(10))
        cat = lambda k, t: pa.array(np.concatenate(cols[k]).astype(t) if cols[k] else np.zeros(0, t))
        return pa.table({"doc_id": d.column("doc_id"), "trained": d.column("_train"), "n_tokens": cat(0, np.int64), "n_known": cat(1, np.int64), "base_score": cat(2, float), "score": cat(3, float)})

    scored = base.groupBy("block").cogroup(per_block.groupBy("block")).applyInArrow(lean(run, 2), f"doc_id {id_type}, trained boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "trained", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
