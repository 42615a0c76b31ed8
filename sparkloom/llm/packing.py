"""Best-fit packing of token pieces into sequences by bin completion.

Lengths are integers up to the capacity, so the whole packing problem is the
histogram of lengths: at most ``capacity`` counts, whatever the number of
documents. The branch-and-bound runs over that histogram. It fills one bin
around the largest length, over undominated fillings in order of waste (any
number of pieces, found by exact subset sums), applies a filling as often as
the counts allow, prunes by the waste bound and keeps best-fit-decreasing
solutions as incumbents. Where best fit already meets the bound, that solution
is optimal and no node is visited. ``Solution`` reports the gap to the bound.
The result is a short list of patterns, from which Spark assigns every piece
its sequence and offset by its rank among the pieces of equal length. Ranks
are taken in salted buckets, so that one very common length does not meet in
one task.

Defined cases: a null text is the empty text and packs as its end token;
only documents longer than the capacity are cut (the first piece is the
short one); repeated rows are packed each for itself; an empty table gives an
empty result; further columns are not carried.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import written
from sparkloom.llm.token_counts import encoded, encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary"
Pattern = tuple[int, tuple[tuple[int, int], ...]]  # times, ((length, number in a bin), ...)


def pieces_of(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            parts = groupby(encoded(b.column(1).to_pylist(), enc), key=lambda p: p[0])
            at, got = next(parts, (b.num_rows, ()))
            for place, doc in enumerate(b.column(0).to_pylist()):
                mine: list[int] = []
                if place == at:  # empty texts have no parts
                    mine = [t for _, ids in got for t in ids]
                    at, got = next(parts, (b.num_rows, ()))
                ids = np.array([*mine, end_id], "<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                for k, a in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[a : first if k == 0 else a + capacity]
                    for col, v in zip(rows, (doc, k, a, len(part), part.tobytes()), strict=True):
                        col.append(v)
                if len(rows[0]) >= 2000:
                    yield batch(rows)
                    rows = ([], [], [], [], [])
            if rows[0]:
                yield batch(rows)

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def batch(rows: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def waste_bound(counts: dict[int, int], cap: int) -> int:
    """A lower bound of the number of bins (total size, and Martello and Toth's L2 for every split length)."""
    if not counts:
        return 0
    s = np.array(sorted(counts), np.int64)
    c = np.array([counts[x] for x in s.tolist()], np.int64)
    number, size = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * s)))
    half = np.searchsorted(s, cap // 2, "right")  # lengths from here on fill more than half a bin
    k = np.concatenate(([0], s[:half]))
    wide = np.maximum(np.searchsorted(s, cap - k, "right"), half)  # lengths from here on leave no room for k
    room = cap * (number[wide] - number[half]) - (size[wide] - size[half])
    small = size[half] - size[np.searchsorted(s[:half], k)]
    rest = np.maximum(0, -(-(small - room) // cap))
    return int(max(-(-int(size[-1]) // cap), (number[-1] - number[half] + rest).max()))


def best_fit(counts: dict[int, int], cap: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal open bins are kept as one group."""
    groups: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, bins: tuple) -> None:
        if times:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((times, bins))

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                per = cap // s
                put(cap - per * s, c // per, ((s, per),))
                if c % per:
                    put(cap - c % per * s, 1, ((s, c % per),))
                break
            room = rooms[at]
            times, bins = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            per = room // s
            full = min(times, c // per)
            put(room - per * s, full, (*bins, (s, per)))
            c -= full * per
            if full < times:
                rest = min(c, per - 1) if per > 1 and c < per else 0
                if rest:
                    put(room - rest * s, 1, (*bins, (s, rest)))
                    c -= rest
                put(room, times - full - bool(rest), bins)
    return [(t, b) for gs in groups.values() for t, b in gs]


def dominates(x: tuple[int, ...], y: tuple[int, ...]) -> bool:
    """Whether y's elements fit into x's, each as a box: then x in its place is never worse."""
    rooms = list(x)
    for e in sorted(y, reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= e), key=lambda k: rooms[k], default=None)
        if k is None:
            return False
        rooms[k] -= e
    return True


def completions(counts: dict[int, int], room: int) -> Iterator[tuple[int, ...]]:
    """Multisets of counted lengths that fit the room and leave no length that
    would still fit, least waste first, larger elements first among equal ones.

    reach[i] has bit v set where the i smallest lengths can fill exactly v, so
    the search below never enters a branch without a filling.
    """
    sizes = [s for s in sorted(counts) if s <= room]
    full, reach = (1 << room + 1) - 1, [1]
    for s in sizes:
        bits, left, k = reach[-1], min(counts[s], room // s), 1
        while left:
            k = min(k, left)
            bits |= bits << s * k & full
            left, k = left - k, 2 * k
        reach.append(bits)

    def fill(i: int, v: int) -> Iterator[tuple[int, ...]]:
        while i and v:
            s = sizes[i - 1]
            at = [k for k in range(min(counts[s], v // s), -1, -1) if reach[i - 1] >> v - k * s & 1]
            if at != [0]:
                for k in at:
                    for rest in fill(i - 1, v - k * s):
                        yield (s,) * k + rest
                return
            i -= 1
        if not v:
            yield ()

    for waste in range(room + 1):
        if reach[-1] >> room - waste & 1:
            for f in fill(len(sizes), room - waste):
                if not any(s <= waste and f.count(s) < counts[s] for s in sizes):
                    yield f


def fillings(counts: dict[int, int], cap: int, width: int, look: int = 8, narrow: list[bool] | None = None) -> Iterator[tuple[tuple[int, int], ...]]:
    """Up to width fillings of a bin around the largest length, as ((length, number), ...).

    Of the first look * width completions those that another one there
    dominates are left out; the first is never dominated by a later one. Where
    there may be more than these, narrow[0] is set.
    """
    top = max(counts)
    rest = {s: c - (s == top) for s, c in counts.items() if c > (s == top)}
    found: list[tuple[int, ...]] = []
    for k, x in enumerate(completions(rest, cap - top)):
        if len(found) >= width or k >= look * width:
            if narrow is not None:
                narrow[0] = True
            return
        if k and any(dominates(y, x) for y in found):
            continue
        found.append(x)
        use: dict[int, int] = {top: 1}
        for s in x:
            use[s] = use.get(s, 0) + 1
        yield tuple(sorted(use.items(), reverse=True))


@dataclass(frozen=True)
class Solution:
    """Patterns, their number of bins, the waste bound, and the nodes visited.

    bins - bound is the gap: 0 means that the solution is proven optimal.
    """

    patterns: list[Pattern]
    bins: int
    bound: int
    visited: int


def bin_completion(counts: dict[int, int], cap: int, nodes: int = 4000, width: int = 6, look: int = 8, offer_every: int = 16) -> Solution:
    """Holds all counted lengths in as few bins as found.

    A step fills bins around the largest length with one filling, as often as
    the counts allow. Search goes by limited discrepancy: first always the
    filling of least waste, then with one other choice (another filling, or
    the same for one bin only), then two, and so on. Nodes whose waste bound
    reaches the best solution are left; best-fit decreasing over what is left
    completes nodes to solutions (every node where fewer than 64 lengths are
    left, else every offer_every-th, as it costs as much as many nodes). A node
    has up to width fillings, of its first look * width completions; where all
    that is searched, width doubles and the search begins anew, until it has
    left out nothing. Stops at the waste bound (then optimal), when all is
    searched, or after `nodes` nodes with the best solution so far: the only
    limit, and Solution tells the gap it may leave.
    """
    counts = {int(s): int(c) for s, c in counts.items() if c}
    number = lambda sol: sum(t for t, _ in sol)
    best = best_fit(counts, cap) if counts else []
    bound, visited, cut = waste_bound(counts, cap), 0, False

    def offer(taken: list[Pattern], rest: dict[int, int]) -> None:
        nonlocal best
        sol = [*taken, *best_fit(rest, cap)] if rest else taken
        if number(sol) < number(best):
            best = sol

    def step(rest: dict[int, int], f: tuple[tuple[int, int], ...], times: int) -> dict[int, int]:
        nxt = dict(rest)
        for s, k in f:
            nxt[s] -= times * k
            if not nxt[s]:
                del nxt[s]
        return nxt

    def search(rest: dict[int, int], taken: list[Pattern], used: int, others: int) -> None:
        """Goes on along first choices in a loop; `others` more other choices may be made."""
        nonlocal visited, cut
        taken = list(taken)
        while number(best) > bound:
            if visited >= nodes:
                cut = True
                return
            visited += 1
            if not rest or used + waste_bound(rest, cap) >= number(best):
                return offer(taken, rest) if not rest else None
            if not others and (len(rest) < 64 or visited % offer_every == 0):
                offer(taken, rest)
            options = fillings(rest, cap, width, look, narrow)
            first = next(options)
            times = min(rest[s] // k for s, k in first)
            cut |= not others
            if others:
                for f in options:
                    most = min(rest[s] // k for s, k in f)
                    search(step(rest, f, most), [*taken, (most, f)], used + most, others - 1)
                    if number(best) == bound or visited >= nodes:
                        return
                if times > 1:
                    search(step(rest, first, 1), [*taken, (1, first)], used + 1, others - 1)
            rest, used = step(rest, first, times), used + times
            taken.append((times, first))

    others, narrow = 0, [False]
    while number(best) > bound and visited < nodes:
        cut = False
        search(counts, [], 0, others)
        others += 1
        if not cut:  # every choice was followed
            if not narrow[0]:
                break
            others, narrow[0], width = 0, False, 2 * width
    return Solution(best, number(best), bound, visited)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a sequence, offset of the first)."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for times, bins in patterns:
        off = 0
        for s, k in bins:
            a = rank.get(s, 0)
            rank[s] = a + times * k
            out.append((s, a, rank[s], base, k, off))
            off += s * k
        base += times
    return out


def pack(pieces: DataFrame, capacity: int = 2048, bucket_pieces: int = 5000, nodes: int = 4000, broadcast_slots: int = 250_000, gap: str | None = None) -> DataFrame:
    """pieces (with doc_id, piece, length) with sequence_id and offset (long);
    in the column gap, if named, how many sequences more than the waste bound
    were used (0: proven the least).

    Only the histogram (at most `capacity` rows) reaches the driver; the slot
    table sent back holds one row a length and pattern and is broadcast up to
    `broadcast_slots` rows, beyond which Spark joins it by length. Pieces are
    written once with a salt that deals them into buckets, so rows that repeat
    an id spread like others; pass them without wide columns.
    """
    spark = pieces.sparkSession
    cols = pieces.columns
    salted = written(pieces.withColumn("_salt", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())), "pack-pieces")
    n_buckets = max(16, salted.count() // bucket_pieces)
    keyed = salted.withColumn("_bucket", F.pmod("_salt", F.lit(n_buckets)))
    counts = written(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "pack-counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(s is None or s > capacity or s < 1 for s in hist):
        raise ValueError("a piece is longer than the capacity, or empty")
    solution = bin_completion(hist, capacity, nodes)
    table = slots(solution.patterns)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("_salt", "doc_id", "piece")
    ranked = keyed.withColumn("_rank", F.row_number().over(order) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    slot = spark.createDataFrame(table or [(0, 0, 0, 0, 1, 0)], "length long, r0 long, r1 long, seq0 long, per long, off0 long")
    slot = F.broadcast(slot) if len(table) <= broadcast_slots else slot
    j = ranked.alias("p").join(slot.alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("_rank") >= F.col("r0")) & (F.col("_rank") < F.col("r1")))
    k = F.col("_rank") - F.col("r0")
    return j.select(
        *[F.col(f"p.{c}") for c in cols],
        (F.col("seq0") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("off0") + (k % F.col("per")) * F.col("p.length")).cast("long").alias("offset"),
        *([F.lit(solution.bins - solution.bound).cast("long").alias(gap)] if gap else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Real sequences from packed pieces with ids: sequence_id, n_tokens, ids (binary), pieces.

    A group holds at most `capacity` tokens.
    """
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("p"))
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), ids.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))
