"""Token ids in files: an adaptive context-mixing range coder over independent blocks.

Blocks of up to 2048 ids are coded each from an empty model. Two contexts predict ids:
the last two ids (one candidate) and the last id (two candidates); below them stands
the order-0 model, the counts of the ids so far, with an escape to ids not yet seen.
The share of each prediction is learnt as it goes, by how sure the contexts are; where
contexts agree on an id their shares add. A 64-bit range coder codes the choice and, where
no context had the id, its place in order 0, all in one interval an id. Ids that order 0
has not counted stand in 16 bits each behind the block's words.

All blocks of a batch go in step: one NumPy operation advances every block by one id, so
the coder needs no compiled code. A batch has at most 4096 blocks of 2048 ids, which
bounds a task's memory; ids are streamed through it whatever a file's or document's size.

A file: magic; the blocks; a footer with, for each block, offset, bytes, ids and the CRC-32 of
its bytes and of its ids, and for each document id and number of ids; the footer's length and
CRC-32; magic.
Executors write files into the shared folder, each attempt under a name of its own; the
index, written by Spark's own commit, names those that count.

Defined cases: a null text is empty, so it has its end id alone; ids ascend, null ids last;
rows of one id follow each other by their token ids; an empty table gives no file; other
columns are not read. A block whose bytes or ids do not have their checksum raises an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import new_path, written

BLOCK, LEAST, LANES = 2048, 1024, 4096
MAGIC = b"SLRC0002"
FILES = "path string, part long, n_ids long, n_docs long, n_blocks long, n_bytes long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"

_S2, _S1 = 1 << 11, 1 << 10
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_32, _WORD, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(1 << 32)
#: Keeps a quotient of rounded doubles at or below the true one.
_BELOW = 1 - 2.0**-50
#: Shares lie packed, 16 bits each: last id's first candidate, last two ids' one, last id's second, order 0. A product with _ENDS sums them up.
_START, _LIMIT, _HALF, _ENDS = 3 | 6 << 16 | 2 << 32 | 8 << 48, 1 << 12, 0x7FFF7FFF7FFF7FFF, 0x0001000100010001
#: By the candidates that are right (bits 1, 2, 4, in the order of the shares): what the shares gain, and which ends bound
#: the interval. Where contexts agree on an id, it has the intervals of both, which lie side by side.
_GAIN = np.array([16 << 48] + [sum(16 << 16 * k for k in range(3) if hits >> k & 1) for hits in range(1, 8)])
_FROM, _TO = np.array([48, 0, 16, 0, 32, 0, 16, 0]), np.array([48, 0, 16, 16, 32, 0, 32, 16])
#: By how sure the contexts of two ids (times 32) and of one (times 8) were, 0 to 3, and the candidates that are right: how sure they are now.
_SURE = np.array([[0, 0, 1, 1], [1, 2, 3, 3]])
_SURE2 = np.array([_SURE[k >> 1 & 1, k >> 5] << 18 for k in range(128)])
_SURE1 = np.array([_SURE[k & 1, k >> 3 & 3] << 32 for k in range(128)])


class _Encoder:
    """Range coders of all lanes: intervals in, 32-bit words out.

    Each step notes for every lane the word that may leave, whether it does, and whether a carry runs back
    into the words before it; done() puts them together.
    """

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
        self.before, self.each, self.share = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64), _Share(lanes)
        self.words, self.out, self.carry = np.empty((steps + 2, lanes), np.uint32), np.ones((steps + 2, lanes), bool), np.zeros((steps + 2, lanes), bool)
        self.n = 0

    def put(self, m: int, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        """For the first m lanes."""
        before, low, each, out, carry = self.low, self.before, self.each, self.out[self.n], self.carry[self.n]
        self.share(self.range, total, each)
        np.multiply(start.view(np.uint64), each, out=low)
        low += before
        np.less(low, before, out=carry)
        np.multiply(size.view(np.uint64), each, out=self.range)
        np.less(self.range, _LOW, out=out)
        if m < len(low):
            low[m:], out[m:], carry[m:] = before[m:], False, False
        np.right_shift(low, _32, out=each)
        self.words[self.n] = each
        each[:] = out
        each <<= np.uint64(5)
        low <<= each
        self.range <<= each
        self.low, self.before = low, before
        self.n += 1

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of all lanes, one lane after the other, and the number of each."""
        self.words[-2:] = self.low >> _32, self.low & _WORD
        out = np.ascontiguousarray(self.out.T)
        words, counts = np.ascontiguousarray(self.words.T)[out], out.sum(1)
        if self.carry.any():
            lane, step = np.ascontiguousarray(self.carry.T).nonzero()
            # as many words of the lane are out before the step
            at = np.cumsum(out, dtype=np.int32)[lane * out.shape[1] + step] - out[lane, step] - 1
            while len(at):
                np.add.at(words, at, np.uint32(1))
                at = at[words[at] == 0] - 1
        return words, counts


class _Decoder:
    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.at = words, np.cumsum(counts) - counts
        self.code = words[self.at].astype(np.uint64) << _32 | words[self.at + 1]
        self.at += 2
        self.range, self.each, self.share = np.full(len(counts), _FULL), np.zeros(len(counts), np.uint64), _Share(len(counts))

    def value(self, total: np.ndarray) -> np.ndarray:
        self.share(self.range, total, self.each)
        return np.minimum((self.code // self.each).view(np.int64), total - 1)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        """Passes the interval that value() fell into."""
        np.multiply(size.view(np.uint64), self.each, out=self.range)
        self.each *= start.view(np.uint64)
        self.code -= self.each
        k = (self.range < _LOW).nonzero()[0]
        if len(k):
            at = self.at[k]
            self.code[k] = self.code[k] << _32 | self.words.take(at, mode="clip")
            self.range[k] = self.range[k] << _32
            self.at[k] = at + 1


class _Share:
    """The range over the total, at most: double precision gives both sides the same, below 2^-8 of a share off (total < 2^24)."""

    def __init__(self, lanes: int):
        self.a, self.b = np.zeros(lanes), np.zeros(lanes)

    def __call__(self, rng: np.ndarray, total: np.ndarray, out: np.ndarray) -> None:
        self.a[:], self.b[:] = rng, total
        self.a *= _BELOW
        self.a /= self.b
        np.copyto(out, self.a, casting="unsafe")


def _whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of small numbers, by way of doubles, where it is exact."""
    return (a / b).astype(np.int64)


class _Model:
    """Predictions of all lanes; encoder and decoder advance it alike. Its arrays of one step are used again in the next."""

    def __init__(self, lanes: int):
        self.order2, self.order1 = np.zeros(lanes * _S2, np.int32), np.zeros(lanes * _S1, np.int64)
        self.shares = np.full(lanes * 16, _START)
        lane = np.arange(lanes)
        self.base2, self.base1, self.base = lane * _S2, lane * _S1, lane * 16
        self.one, self.mixed, self.two = np.zeros((3, lanes), np.int64)
        self.i1, self.i2, self.e1, self.e2, self.a, self.b, self.c, self.sure, self.ctx, self.row, self.ends, self.all = np.zeros((12, lanes), np.int64)
        self.bits, self.start, self.share, self.some = np.zeros((4, lanes), np.int64)
        self.kept, self.flags, self.keep = np.zeros(lanes, np.int32), np.zeros((3, lanes), bool), np.zeros(lanes, bool)
        self.n, self.counted, self.novel = 0, 0, np.ones(lanes, np.int64)
        #: total of order 0 with the share of ids not counted
        self.total = self.novel

    def predict(self) -> None:
        """Three candidates a lane and the ends of their shares."""
        i1, i2, e1, e2 = self.i1, self.i2, self.e1, self.e2
        np.right_shift(self.mixed, 5, out=i1)
        i1 &= _S1 - 1
        i1 += self.base1
        np.add(self.mixed, self.two, out=i2)
        i2 >>= 4
        i2 &= _S2 - 1
        i2 += self.base2
        self.order1.take(i1, mode="clip", out=e1)
        self.order2.take(i2, mode="clip", out=self.kept)
        e2[:] = self.kept
        np.bitwise_and(e2, 0xFFFF, out=self.a)
        np.bitwise_and(e1, 0xFFFF, out=self.b)
        np.greater_equal(e2, 2 << 18, out=self.keep)
        np.right_shift(e1, 16, out=self.c)
        e2 >>= 16
        e1 >>= 32
        self.c &= 0xFFFF
        np.add(e1, e2, out=self.sure)
        np.add(self.sure, self.base, out=self.ctx)
        self.shares.take(self.ctx, mode="clip", out=self.row)
        np.multiply(self.row, _ENDS, out=self.ends)
        np.right_shift(self.ends, 48, out=self.all)

    def right(self, x: np.ndarray) -> np.ndarray:
        """The candidates that are x, as bits."""
        for found, flags in zip((self.b, self.a, self.c), self.flags, strict=True):
            np.equal(x, found, out=flags)
        b, a, c = self.flags.view(np.uint8)
        a += a
        c <<= 2
        a |= c
        a |= b
        self.bits[:] = a
        return self.bits

    def interval(self, right: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the interval, of all * total: that of the candidates or, in the share of order 0, that of first and size there.

        Where a candidate is right, first is 0 and size the total of order 0.
        """
        start, share, some = self.start, self.share, self.some
        np.left_shift(self.ends, 16, out=start)
        start >>= _FROM.take(right, mode="clip", out=some)
        start &= 0xFFFF
        np.right_shift(self.ends, _TO.take(right, mode="clip", out=some), out=share)
        share &= 0xFFFF
        share -= start
        start *= self.total
        np.multiply(share, first, out=some)
        start += some
        share *= size
        return start, share

    def learn(self, x: np.ndarray, right: np.ndarray) -> None:
        row, key, some = self.row, self.sure, self.some
        row += _GAIN.take(right, mode="clip", out=some)
        self.shares[self.ctx] = row
        key <<= 3
        key += right
        # a sure candidate stays
        kept = np.where(self.keep, self.a, x)
        kept |= _SURE2.take(key, mode="clip", out=some)
        self.kept[:] = kept
        self.order2[self.i2] = self.kept
        kept = np.where(self.flags[0], self.c, self.b)
        kept <<= 16
        kept |= x
        kept |= _SURE1.take(key, mode="clip", out=some)
        self.order1[self.i1] = kept
        np.multiply(self.one, 60493, out=self.two)
        np.multiply(x, 40503, out=self.mixed)
        self.one = x
        self.n += 1
        if self.n % 64 == 0:
            # 64 steps add 3072 at most, so all shares stay below 2^13
            full = (self.shares * _ENDS >> 48 > _LIMIT).nonzero()[0]
            self.shares[full] = self.shares[full] >> 1 & _HALF | _ENDS

    def due(self) -> bool:
        """Whether order 0 is to be counted anew, from all ids so far: at 16, 64, 256, 1024."""
        return self.n in (16, 64, 256, 1024)

    def count(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts order 0 from the ids so far, one lane a row. A lane's ids lie sorted, so a count's place is a position.

        Returns the ids sorted, and where runs of equal ids begin and their sizes.
        """
        lanes, t = seen.shape
        ids = np.sort(seen, axis=1, kind="stable").ravel()
        change = np.ones(lanes * t, bool)
        np.not_equal(ids[1:], ids[:-1], out=change[1:])
        change[::t] = True
        runs = change.nonzero()[0]
        self.counted, self.novel = t, np.bincount(runs // t, minlength=lanes)
        self.total = self.novel + t
        return ids, runs, np.diff(runs, append=lanes * t)


def _sizes(n: int) -> np.ndarray:
    """Block sizes for n ids: equal but for one, 2048 at most, and smaller ones rather than few lanes."""
    blocks = max(-(-n // BLOCK), min(256, n // LEAST), 1)
    return np.full(blocks, n // blocks) + (np.arange(blocks) < n % blocks)


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The blocks of a batch of ids (uint16) and their sizes.

    A block: the words of the range coder, the ids that order 0 did not know, the number of these.
    """
    sizes = _sizes(len(ids))
    lanes, steps, short = len(sizes), int(sizes[0]), int(sizes[-1])
    own, many = np.zeros((lanes, steps), np.uint16), int((sizes == steps).sum())
    own[:many] = ids[: many * steps].reshape(many, steps)
    own[many:, :short] = ids[many * steps :].reshape(lanes - many, short)
    coming, missed, new = np.ascontiguousarray(own.T), np.zeros((steps, lanes), bool), np.ones((steps, lanes), bool)
    model, coder = _Model(lanes), _Encoder(lanes, steps)
    # of the ids up to the next count: their place and number in order 0 (times 2^16); of a lane: the total for ids that a context has
    placed, began, whole, here = np.full((steps, lanes), 1 << 16, np.int32), 0, model.total << 16, np.zeros(lanes, np.int64)
    for t in range(steps):
        m = lanes if t < short else many
        x = coming[t].astype(np.int64)
        model.predict()
        right = model.right(x)
        np.equal(right, 0, out=missed[t])
        here[:] = placed[t - began]
        size = np.where(missed[t], here, whole)
        first = size & 0xFFFF
        size >>= 16
        start, share = model.interval(right, first, size)
        coder.put(m, start, share, np.multiply(model.all, model.total, out=first))
        model.learn(x, right)
        if model.due():
            began = t + 1
            known, runs, n = model.count(own[:, :began])
            upto = 4 * began if began < 1024 else steps
            at = _looked_up(known[runs], runs % began | n << 16, np.bincount(runs // began, minlength=lanes), own[:, began:upto])
            placed, whole = np.ascontiguousarray(at.T), model.total << 16
            np.less(placed, 0, out=new[began:upto])
            np.copyto(placed, (began | model.novel << 16).astype(np.int32), where=new[began:upto])
    missed[short:, many:] = False
    unknown = missed & new
    words, n_words = coder.done()
    unknown = np.ascontiguousarray(unknown.T)
    data, rest, n_rest = words.astype("<u4").tobytes(), own[unknown].astype("<u2").tobytes(), unknown.sum(1)
    at, to = 4 * np.cumsum(n_words), 2 * np.cumsum(n_rest)
    cuts = zip((at - 4 * n_words).tolist(), at.tolist(), (to - 2 * n_rest).tolist(), to.tolist(), n_rest.tolist(), strict=True)
    return [b"".join((data[i:j], rest[k:e], struct.pack("<H", n))) for i, j, k, e, n in cuts], sizes


def _looked_up(ids: np.ndarray, values: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each lane's ids asked for, the value of that id among the lane's own (n a lane, one after the other), or -1. One table by id serves all lanes."""
    table, out, values, begin = np.full(1 << 16, -1, np.int32), np.empty(asked.shape, np.int32), values.astype(np.int32), 0
    for lane, end in enumerate(np.cumsum(n).tolist()):
        own = ids[begin:end]
        table[own] = values[begin:end]
        table.take(asked[lane], mode="clip", out=out[lane])
        table[own] = -1
        begin = end
    return out


def decode_blocks(blocks: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of blocks whose sizes descend and differ by one at most."""
    lanes, steps, short = len(sizes), int(sizes[0]), int(sizes[-1])
    many = int((sizes == steps).sum())
    n_rest = np.array([b[-2] | b[-1] << 8 for b in blocks])
    ends = [len(b) - 2 - 2 * n for b, n in zip(blocks, n_rest.tolist(), strict=True)]
    words = np.frombuffer(b"".join(b[:e] for b, e in zip(blocks, ends, strict=True)), "<u4")
    rest = np.frombuffer(b"".join(b[e:] for b, e in zip(blocks, ends, strict=True)), "<u2")  # with the numbers, so never empty
    at_rest = np.cumsum(n_rest + 1) - n_rest - 1
    model, coder, seen, counts = _Model(lanes), _Decoder(words, np.array(ends) // 4), np.zeros((steps, lanes), np.uint16), np.full(lanes, 1 << 32)
    # a lane's places in order 0, and one more for all ids new to it: the id, its place (times 2^16) and number (times 2^32)
    row, whole, here = np.arange(lanes), model.total << 32, np.zeros(lanes, np.int64)
    for t in range(steps):
        model.predict()
        total = model.total
        v = coder.value(model.all * total)
        share = _whole(v, total)
        ends = model.ends
        x = np.where(share < (ends & 0xFFFF), model.b, np.where(share < (ends >> 16 & 0xFFFF), model.a, model.c))
        here[:] = whole
        third = ends >> 32 & 0xFFFF
        k = (share >= third).nonzero()[0]
        if len(k):
            third = third[k]
            v = _whole(v[k] - third * total[k], model.all[k] - third)
            new = v >= model.counted
            here[k] = found = counts.take(row[k] + np.minimum(v, model.counted), mode="clip")
            x[k] = found & 0xFFFF
            if len(k := k[new]):
                at = at_rest[k]
                x[k] = rest.take(at, mode="clip")
                at_rest[k] = at + 1
        first = here >> 16
        first &= 0xFFFF
        here >>= 32
        right = model.right(x)
        coder.take(*model.interval(right, first, here))
        model.learn(x, right)
        seen[t] = x
        if model.due():
            ids, runs, n = model.count(seen[: t + 1].T)
            counts = np.empty((lanes, t + 2), np.int64)
            counts[:, :-1] = (np.repeat(runs % (t + 1) << 16 | n << 32, n) | ids).reshape(lanes, t + 1)
            counts[:, -1] = t + 1 << 16 | model.novel << 32
            counts, row, whole = counts.ravel(), np.arange(lanes) * (t + 2), model.total << 32
    return np.concatenate((seen[:, :many].T.ravel(), seen[:short, many:].T.ravel()))


def _footer(blocks: np.ndarray, docs: list[int | None], counts: list[int]) -> bytes:
    """blocks: rows of offset, bytes, ids, CRC-32 of the bytes, CRC-32 of the ids."""
    body = struct.pack("<qq", len(blocks), len(docs)) + blocks.astype("<i8").tobytes()
    body += np.array([d is not None for d in docs], "u1").tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(counts, "<i8").tobytes()
    return body + struct.pack("<qI", len(body), zlib.crc32(body)) + MAGIC


def read_footer(f) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Block rows (offset, bytes, ids, both sums), document ids and their numbers of ids, of an open file."""
    size = f.size()
    f.seek(size - 20)
    n, crc, magic = struct.unpack("<qI8s", f.read(20))
    f.seek(size - 20 - n)
    body = f.read(n)
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("no footer, or a damaged one")
    n_blocks, n_docs = struct.unpack_from("<qq", body)
    blocks = np.frombuffer(body, "<i8", 5 * n_blocks, 16).reshape(-1, 5)
    at = 16 + 40 * n_blocks
    there = np.frombuffer(body, "u1", n_docs, at)
    names = np.frombuffer(body, "<i8", n_docs, at + n_docs)
    return blocks, [int(d) if ok else None for d, ok in zip(names, there, strict=True)], np.frombuffer(body, "<i8", n_docs, at + 9 * n_docs)


class _Writer:
    """One file, batch by batch."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.f, self.size = store.open_output_stream(path, compression=None), len(MAGIC)
        self.f.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.n, self.ids, self.blocks, self.docs, self.counts = 0, 0, [], [], []

    def add(self, docs: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs += docs
        self.counts += counts.tolist()
        self.held.append(ids)
        self.n += len(ids)
        while self.n >= BLOCK * LANES:
            self._flush(BLOCK * LANES)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        self.held = [ids[n:]]
        self.n -= n
        payloads, sizes = encode_blocks(ids[:n])
        sums, at = ids[:n].astype("<u4"), 0
        for data, k in zip(payloads, sizes.tolist(), strict=True):
            self.f.write(data)
            self.blocks.append((self.size, len(data), k, zlib.crc32(data), zlib.crc32(sums[at : at + k])))
            self.size += len(data)
            at += k
        self.ids += n

    def close(self) -> None:
        if self.n:
            self._flush(self.n)
        tail = _footer(np.array(self.blocks, np.int64).reshape(-1, 5), self.docs, self.counts)
        self.f.write(tail)
        self.size += len(tail)
        self.f.close()


def id_dir(spark) -> str:
    path = new_path(spark, "token-ids")
    return path if "://" in path else f"file://{path}"


def write_ids(encoded: DataFrame, out: str, file_bytes: int = 16 << 20) -> DataFrame:
    """Write (doc_id, ids: little-endian uint16) in ascending order of doc_id below the folder out; returns the index of files (FILES).

    encoded should be a stored table: its ids are read once to deal out ranges and once to write.
    """
    spark = encoded.sparkSession
    total = encoded.agg(F.coalesce(F.sum(F.octet_length("ids").cast("long")), F.lit(0))).first()[0]
    parts = max(1, min(-(-total // file_bytes), 1_000_000), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (1 << 18)))
    # rows that repeat an id spread by their ids, and by a number of their own where these repeat as well
    keyed = encoded.select(F.col("doc_id").cast("long"), "ids", F.xxhash64("ids").alias("_h"), F.monotonically_increasing_id().alias("_r"))
    order = [F.col("doc_id").asc_nulls_last(), "_h", "_r"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    names = [x.split()[0] for x in FILES.split(", ")]
    schema = pa.schema([pa.field(c, pa.string() if c == "path" else pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, path = None, ""
        store, root = fs.FileSystem.from_uri(out)
        part = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            if w is None:
                store.create_dir(root, recursive=True)
                path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                w = _Writer(store, path)
            col = b.column(1)
            ends = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset)
            ids = np.frombuffer(col.buffers()[2], "<u2", int(ends[-1] - ends[0]) // 2, int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, "<u2")
            w.add(b.column(0).to_pylist(), ids.copy(), np.diff(ends) // 2)
        if w is not None:
            w.close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, (path, part, w.ids, len(w.docs), len(w.blocks), w.size), strict=True))], schema)

    return written(ordered.mapInArrow(run, FILES), "token-id-files")


def read_ids(files: DataFrame, out: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files (DOCS): its place among the ids of all, number, CRC-32 and, unless left out, its ids as little-endian uint32.

    A task decodes whole files, batch by batch; every block is checked against its sum.
    """
    spark = files.sparkSession
    # one row a file: the files before a file are those of smaller parts
    placed = files.select("path", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("base"))
    names = [x.split()[0] for x in DOCS.split(", ")][: 5 if with_ids else 4]
    schema = ", ".join(DOCS.split(", ")[: len(names)])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(out)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    blocks, docs, counts = read_footer(f)
                    rows, d, need, start, crc = [], 0, int(counts[0]), base, 0
                    parts: list[bytes] = []
                    for ids in _decoded(f, blocks):
                        data, at = ids.astype("<u4"), 0
                        while d < len(docs) and (take := min(need, len(data) - at)) >= 0 and (take or not need):
                            piece = data[at : at + take].tobytes()
                            crc = zlib.crc32(piece, crc)
                            if with_ids:
                                parts.append(piece)
                            at += take
                            need -= take
                            if need:
                                break
                            rows.append((docs[d], start, int(counts[d]), crc, b"".join(parts)))
                            start += int(counts[d])
                            d, crc, parts = d + 1, 0, []
                            need = int(counts[d]) if d < len(docs) else 0
                            if len(rows) >= 5000:
                                yield batch(rows)
                                rows = []
                    if d < len(docs):
                        raise ValueError(f"{path} ends before its documents")
                    if rows:
                        yield batch(rows)

    return placed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)).mapInArrow(run, schema)


def _decoded(f, blocks: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of a file in order, a batch of blocks at a time."""
    if not len(blocks):
        yield np.zeros(0, np.uint16)
    at = 0
    while at < len(blocks):
        n = blocks[at : at + LANES, 2]
        odd = np.flatnonzero((n > n[0]) | (n < n[0] - 1) | (np.diff(n, prepend=n[0]) > 0))
        some = blocks[at : at + (odd[0] if len(odd) else len(n))]
        at += len(some)
        f.seek(int(some[0, 0]))
        data = f.read(int(some[:, 1].sum()))
        payloads = [data[e - k : e] for e, k in zip(np.cumsum(some[:, 1]).tolist(), some[:, 1].tolist(), strict=True)]
        if [zlib.crc32(x) for x in payloads] != some[:, 3].tolist():
            raise ValueError("a block's bytes do not have its checksum")
        ids = decode_blocks(payloads, some[:, 2])
        cut, sums = np.cumsum(some[:, 2]), ids.astype("<u4")
        for e, k, crc in zip(cut.tolist(), some[:, 2].tolist(), some[:, 4].tolist(), strict=True):
            if zlib.crc32(sums[e - k : e]) != crc:
                raise ValueError("a block's ids do not have its checksum")
        yield ids


def read_range(f, first: int, n: int) -> np.ndarray:
    """n ids of an open file from its id number first on, decoding only the blocks that hold them."""
    blocks, _, _ = read_footer(f)
    ends = np.cumsum(blocks[:, 2])
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, first + n, "left") + 1
    got = list(_decoded(f, blocks[a:b]))
    skip = first - int(ends[a] - blocks[a, 2]) if a < len(blocks) else 0
    return np.concatenate(got)[skip : skip + n] if got else np.zeros(0, np.uint16)
