"""W2, A3, A4 for keys of any size: a hot key's rows are dealt over tasks as segments, whose summaries compose.

Keys of up to `hot_rows` rows are folded as ever. The rows of larger ones are sorted by
ranges and numbered within their key, which cuts them into segments of `block_rows`.

Quota. Which question opens a session decides which one opens the next: the first at least
a cooldown after the session's last allowed one. That pointer is looked up for all questions
at once, a segment against the segments its times reach. Within a segment pointers contract
to where they leave it; among the places so reached, pointer doubling finds those that lie
on the way from the first question.

Cost. Each turn's cost rounds to six decimals with the total, which is the sum of the
rounded costs but where a cost lies so near a half that the total's own error decides; a
segment keeps the sums between these turns, which are replayed with the true total.

Mean. The floored mean after a segment is a monotone step function of the mean before it
(and of the number of turns before, known from the numbering). A segment tabulates it over
the range of the session's latencies; applying the tables in order gives the last mean.

Summaries of both kinds compose: those of WIDE segments in a row become that of one, again
and again, so the task that ends a session reads WIDE summaries at most.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import accounting, quota
from sparkloom.operators.folds import ordered_fold
from sparkloom.operators.merge import staged, stored
from sparkloom.session import SETTINGS

NONE = np.iinfo(np.int64).min
#: Summaries that become one.
WIDE = 64


def _join(a: DataFrame, b: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """a with what b has for the same values of cols, nulls among them; b's other columns have names of their own."""
    right = b.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return a.join(right, same, how).drop(*[f"_r_{c}" for c in cols])


def positions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with _pos, their number within the key in a total order (from 0). A key's rows lie in as many tasks as its ranges need."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = staged(rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # a row for each key and range
    runs = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = runs.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n"))
    return _join(placed, runs, [key, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("_pos"))


def _split(rows: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of small keys, rows of hot ones, and the hot keys with their number of rows (one key in hot_rows rows at most)."""
    hot = staged(rows.groupBy(key).agg(F.count("*").alias("_total")).where(F.col("_total") > hot_rows))
    return _join(rows, hot, [key], "left_anti"), _join(rows, hot, [key], "left_semi"), hot


def _like(rows: DataFrame, key: str, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(key, rows.schema[key].dataType), *[T.StructField(n, t) for n, t in fields]])


def _longs(key: str, key_col: pa.ChunkedArray, at: np.ndarray, **cols: np.ndarray) -> pa.Table:
    """Rows `at` of a key column beside columns of longs; NONE is null."""
    return pa.table({key: key_col.take(pa.array(at)), **{n: pa.array(v, pa.int64(), mask=v == NONE) for n, v in cols.items()}})


def quota_split(events: DataFrame, user: str, ms: str, tie: str, quota_: int = SETTINGS.quota, cooldown_ms: int = SETTINGS.cooldown_ms, hot_rows: int = 1_000_000, block_rows: int = 65_536) -> DataFrame:
    """quota.quota_fold, with users of more than hot_rows questions dealt over tasks: user, asked, blocked, sessions, open_count."""
    rows = events.select(user, F.col(ms).cast("bigint").alias("_ms"), F.col(tie).alias("_tie"))
    small, large, hot = _split(rows, user, hot_rows)
    folded = quota.quota_fold(small, user, "_ms", "_tie", quota_, cooldown_ms)
    return folded if hot.isEmpty() else folded.unionByName(_pointed(large, hot, user, quota_, cooldown_ms, max(block_rows, quota_)))


def _pointed(rows: DataFrame, hot: DataFrame, user: str, n: int, cooldown_ms: int, block_rows: int) -> DataFrame:
    p = positions(rows, user, ["_ms", "_tie"]).select(user, "_ms", "_pos", F.floor(F.col("_pos") / block_rows).alias("_block"))
    # a segment and the n - 1 questions after it, where its last sessions end
    ahead = p.where((F.col("_block") > 0) & (F.col("_pos") % block_rows < n - 1)).withColumn("_block", F.col("_block") - 1)
    held = staged(p.unionByName(ahead))
    own = F.floor(F.col("_pos") / block_rows) == F.col("_block")
    spans = held.groupBy(user, "_block").agg(F.min("_ms").alias("low"), F.max("_ms").alias("high"), F.max(F.when(own, F.col("_ms"))).alias("own_high"))
    pairs = _like(rows, user, ("_block", T.LongType()), ("other", T.LongType()), ("after", T.LongType()), ("upto", T.LongType()))

    def reach(t: pa.Table) -> pa.Table:
        """The segments that a segment's times plus the cooldown fall into. A row a segment; times ascend, so both ends do."""
        t = t.sort_by("_block")
        low, high, top = (t.column(c).fill_null(NONE).to_numpy() for c in ("low", "high", "own_high"))
        before = np.concatenate(([NONE], top[:-1]))
        a, b = np.searchsorted(top, low + cooldown_ms), np.searchsorted(before, high + cooldown_ms)
        a = np.where(low == NONE, 0, a)  # null times stand first
        size = np.where(high == NONE, 0, np.maximum(b - a, 0))
        at = np.repeat(np.arange(len(top)), size)
        to = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        out = _longs(user, t.column(user), at, _block=at, other=to, after=before[to], upto=top[to])
        return out.set_column(3, "after", pa.array(before[to]))

    met = staged(spans.groupBy(user).applyInArrow(reach, pairs))
    own_rows = held.where(own)
    mine = _join(held, met, [user, "_block"])
    theirs = _join(own_rows.withColumnRenamed("_block", "other"), met, [user, "other"])
    side = lambda df, role: df.select(user, "_block", "other", "after", "upto", F.lit(role).cast("long").alias("role"), "_ms", "_pos")
    tiles = side(mine, 0).unionByName(side(theirs, 1))

    def look_up(t: pa.Table) -> pa.Table:
        t = t.sort_by("_pos")
        role, pos, ms = (t.column(c).fill_null(NONE).to_numpy() for c in ("role", "_pos", "_ms"))
        block, after, upto = t.column("_block")[0].as_py(), t.column("after")[0].as_py(), t.column("upto")[0].as_py()
        at, there = (role == 0).nonzero()[0], (role == 1).nonzero()[0]
        starts = at[: max(0, len(at) - n + 1)]
        starts = starts[pos[starts] // block_rows == block]
        last = ms[at[np.arange(len(starts)) + n - 1]]
        due = last + cooldown_ms
        ok = (last != NONE) & (due > after) & (due <= upto)
        to = np.maximum(pos[there[np.searchsorted(ms[there], due[ok])]], pos[starts[ok]] + n) if len(there) else np.zeros(0, np.int64)
        return _longs(user, t.column(user), starts[ok] if len(there) else starts[:0], _pos=pos[starts[ok]] if len(there) else pos[:0], next=to)

    pointers = tiles.groupBy(user, "_block", "other").applyInArrow(look_up, _like(rows, user, ("_pos", T.LongType()), ("next", T.LongType())))
    pointers = _join(pointers, hot, [user]).where("next < _total").select(user, "_pos", "next")
    known = _join(p, pointers, [user, "_pos"], "left").select(user, "_block", "_pos", "next")

    def contract(t: pa.Table) -> pa.Table:
        """Where the sessions that begin at a question leave the segment, how many there are, and the last one's begin."""
        t = t.sort_by("_pos")
        pos, to = t.column("_pos").to_numpy(), t.column("next").fill_null(NONE).to_numpy()
        leave, count, last = [0] * len(pos), [1] * len(pos), pos.tolist()
        first, end = int(pos[0]), int(pos[-1])
        for k in range(len(pos) - 1, -1, -1):
            j = int(to[k])
            if j == NONE or j > end:
                leave[k] = j
            else:
                leave[k], count[k], last[k] = leave[j - first], count[j - first] + 1, last[j - first]
        return _longs(user, t.column(user), np.arange(len(pos)), _pos=pos, leave=np.array(leave), n=np.array(count), last=np.array(last))

    steps = staged(known.groupBy(user, "_block").applyInArrow(contract, _like(rows, user, *[(c, T.LongType()) for c in ("_pos", "leave", "n", "last")])))
    entries = steps.where("leave is not null").select(user, F.col("leave").alias("_pos")).distinct().unionByName(hot.select(user, F.lit(0).cast("long").alias("_pos")))
    jump = staged(_join(steps, entries, [user, "_pos"], "left_semi").select(user, "_pos", F.col("leave").alias("to")).where("to is not null"))
    reached = hot.select(user, F.lit(0).cast("long").alias("_pos"))
    while True:
        # after k rounds reached holds all places less than 2**k jumps away, and jump leaps 2**k
        new = staged(_join(reached, jump, [user, "_pos"]).select(user, F.col("to").alias("_pos")))
        if new.isEmpty():
            break
        reached = staged(reached.unionByName(new).distinct())
        again = jump.select(user, F.col("to").alias("_then"), F.col("_pos").alias("to"))
        jump = staged(_join(jump, again, [user, "to"]).select(user, "_pos", F.col("_then").alias("to")))
    way = _join(steps, reached, [user, "_pos"], "left_semi").groupBy(user).agg(F.sum("n").alias("sessions"), F.max("last").alias("last"))
    open_ = F.least(F.lit(n).cast("long"), F.col("_total") - F.col("last"))
    asked = (F.col("sessions") - 1) * n + open_
    return _join(way, hot, [user]).select(user, asked.alias("asked"), (F.col("_total") - asked).alias("blocked"), "sessions", open_.alias("open_count"))


def metrics_split(log: DataFrame, session: str, order: list[str], cost: str, latency: str, hot_rows: int = 1_000_000, block_rows: int = 65_536, widest: int = 1 << 20) -> DataFrame:
    """accounting.session_metrics_exact, with sessions of more than hot_rows turns dealt over tasks.

    Sessions whose latencies span more than `widest` values keep their one walk.
    """
    ansi = log.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    rows = log.select(session, *order, F.col(latency).cast("bigint").alias("_l"), F.col(cost).cast("double").alias("_c"))
    _, _, hot = _split(rows, session, hot_rows)
    spans = _join(rows, hot, [session], "left_semi").groupBy(session).agg(F.min("_l").alias("low"), F.max("_l").alias("high"))
    spans = staged(spans.where(F.coalesce(F.col("high") - F.col("low"), F.lit(0)) < widest))
    small = _join(rows, spans, [session], "left_anti")
    walked = accounting.session_metrics_exact(small, session, order, "_c", "_l")
    if spans.isEmpty():
        return walked
    large = positions(_join(rows, spans, [session], "left_semi"), session, order)
    large = _join(large, spans, [session]).select(session, "_l", "_c", "_pos", F.floor(F.col("_pos") / block_rows).alias("_seg"), "low", "high")
    fields = [("_seg", T.LongType()), ("n", T.LongType()), ("gaps", T.ArrayType(T.LongType())), ("lows", T.ArrayType(T.LongType())), ("highs", T.ArrayType(T.LongType())), ("costs", T.ArrayType(T.DoubleType())), ("begins", T.ArrayType(T.LongType())), ("means", T.ArrayType(T.LongType()))]

    def summarise(t: pa.Table) -> pa.Table:
        t = t.sort_by("_pos").combine_chunks()
        one = {"n": t.num_rows}
        c, lat = t.column("_c"), t.column("_l")
        if c.null_count == 0:
            one |= _cost_summary(c.to_numpy())
        if lat.null_count == 0:
            begin = int(t.column("_pos")[0].as_py())
            first, ends = mean_table(lat.to_numpy(), begin, t.column("low")[0].as_py(), t.column("high")[0].as_py())
            one |= {"begins": first, "means": ends}
        kinds = {f.name: pa.list_(pa.float64() if f.name == "costs" else pa.int64()) for f in schema.fields[3:]}
        cols = {session: t.column(session).slice(0, 1), "_seg": t.column("_seg").slice(0, 1), "n": pa.array([one["n"]])}
        return pa.table(cols | {k: pa.array([one.get(k)], kind) for k, kind in kinds.items()})

    schema = _like(rows, session, *fields)
    parts = stored(large.groupBy(session, "_seg").applyInArrow(summarise, schema))
    most = hot.agg(F.max("_total")).first()[0]
    parts = composed(parts, session, -(-most // block_rows))
    out = T.StructType([T.StructField("question_count", T.LongType()), T.StructField("total_cost", T.DecimalType(10, 6)), T.StructField("avg_latency_ms", T.LongType())])

    def step(state: tuple, n: int, gaps, lows, highs, costs, begins, means) -> tuple:
        count, total, avg = state
        if total is not None:
            total = None if gaps is None else _cost_after(total, gaps, lows, highs, costs, ansi)
        if avg is not None:
            avg = None if begins is None else int(means[int(np.searchsorted(begins, avg, "right")) - 1])
        return count + n, total, avg

    done = ordered_fold(parts, session, ["_seg"], [F.col(n) for n, _ in fields[1:]], (0, Decimal(0), 0), step, out)
    return walked.unionByName(done)


def composed(parts: DataFrame, session: str, most: int) -> DataFrame:
    """Summaries of runs of segments, WIDE a session at most. most: the segments of the longest session."""
    columns = parts.columns

    def compose(t: pa.Table) -> pa.Table:
        t = t.sort_by("_seg").combine_chunks()
        whole = lambda c: t.column(c).null_count == 0
        one = {"n": sum(t.column("n").to_pylist())}
        if whole("gaps"):
            one |= _costs_in_row(*(t.column(c).to_pylist() for c in ("gaps", "lows", "highs", "costs")))
        if whole("begins"):
            tables = [[x.values.to_numpy() for x in t.column(c)] for c in ("begins", "means")]
            begins, means = tables[0][0], tables[1][0]
            for first, ends in zip(*(x[1:] for x in tables), strict=True):
                means = ends[np.searchsorted(first, means, "right") - 1]
                new = np.concatenate(([True], means[1:] != means[:-1]))
                begins, means = begins[new], means[new]
            one |= {"begins": begins, "means": means}
        kinds = {c: t.schema.field(c).type for c in columns[3:]}
        cols = {session: t.column(session).slice(0, 1), "_seg": t.column("_up").slice(0, 1), "n": pa.array([one["n"]])}
        return pa.table(cols | {c: pa.array([one.get(c)], kind) for c, kind in kinds.items()})

    while most > WIDE:
        up = parts.withColumn("_up", F.floor(F.col("_seg") / WIDE))
        parts, most = stored(up.groupBy(session, "_up").applyInArrow(compose, parts.schema)), -(-most // WIDE)
    return parts


def _costs_in_row(gaps: list, lows: list, highs: list, costs: list) -> dict:
    """Cost summaries in order as one: a segment's last sum and the next one's first are those of one stretch."""
    out = {"gaps": [0], "lows": [0], "highs": [0], "costs": []}
    for g, low, high, c in zip(gaps, lows, highs, costs, strict=True):
        at = out["gaps"][-1]
        out["lows"][-1], out["highs"][-1] = min(out["lows"][-1], at + low[0]), max(out["highs"][-1], at + high[0])
        out["gaps"][-1] = at + g[0]
        for name, values in (("gaps", g), ("lows", low), ("highs", high)):
            out[name] += values[1:]
        out["costs"] += c
    return out


#: In millionths: a cost nearer than this to a half may round either way with the total. Sums below 10,000 err by less than a hundredth of it.
NEAR = 1e-3


def _cost_summary(c: np.ndarray) -> dict:
    """Sums of the rounded costs (millionths) between the costs near a half, with their lowest and highest running value."""
    out = {"gaps": [], "lows": [], "highs": [], "costs": []}
    micro = c * 1e6
    plain = np.isfinite(micro) & (np.abs(micro) < 2e10)
    whole = np.where(plain, micro, 0.0)
    near = ~plain | (np.abs(np.abs(whole - np.floor(whole)) - 0.5) < NEAR)
    cut = near.nonzero()[0]
    values = np.rint(whole).astype(np.int64)
    for a, b in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(c)], strict=True):
        run = np.cumsum(values[a:b])
        out["gaps"].append(int(run[-1]) if b > a else 0)
        out["lows"].append(int(min(0, run.min())) if b > a else 0)
        out["highs"].append(int(max(0, run.max())) if b > a else 0)
    out["costs"] = c[cut].tolist()
    return out


_MOST = 10_000 * 1_000_000  # decimal(10,6)


def _cost_after(total: Decimal, gaps: list, lows: list, highs: list, costs: list, ansi: bool) -> Decimal | None:
    for k, (gap, low, high) in enumerate(zip(gaps, lows, highs, strict=True)):
        at = int(total.scaleb(6))
        if at + low <= -_MOST or at + high >= _MOST:
            return accounting._six_decimals(math.inf, ansi)
        total = Decimal(at + gap).scaleb(-6)
        if k < len(costs):
            total = accounting.turn((0, total, None), None, costs[k], ansi)[1]
            if total is None:
                return None
    return total


def mean_table(lat: np.ndarray, n: int, low: int, high: int) -> tuple[list[int], list[int]]:
    """The floored mean after turns with these latencies, n turns having gone before: for means of begins[k] and more, ends[k]."""
    if n == 0:
        begins, x = np.array([NONE]), np.array([0])
    else:
        begins = x = np.arange(low, high + 1)
    for k, one in enumerate(lat.tolist()):
        x = (x * (n + k) + one) // (n + k + 1)
        if k % 16 == 0 and len(x) > 1:
            new = np.concatenate(([True], x[1:] != x[:-1]))
            x, begins = x[new], begins[new]
    new = np.concatenate(([True], x[1:] != x[:-1]))
    return begins[new].tolist(), x[new].tolist()
