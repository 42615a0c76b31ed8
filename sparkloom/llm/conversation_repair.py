"""Conversation structure repair by weighted finite-state composition.

A conversation's rows are an input acceptor, one symbol a row; an edit transducer keeps,
re-roles or deletes a row and inserts empty ones; a role grammar accepts (s?(ua)+)?. The
three are composed lazily, state by state, and since no useful path inserts more than two
rows in a place, the composed states have a topological order. The cheapest path over the
weights (cost, labels) is the repair: costs to the end are relaxed backwards, then labels
are read forwards, the least of the best first.

Conversations of any length: rows are sorted over all tasks and cut into segments of 4096
rows at most. A segment's summary is the cost from every grammar state to every other;
summaries of a conversation with several segments are folded at its borders (16 numbers a
segment), each segment then finds its labels alone. Identical rows are counted before the
sort. Only the text hash, which is one chain by its nature, reads a conversation's rows in
one task, in order and a batch at a time.

Defined cases: a null role or text is one space; rows are in the order of turn (nulls
first), role, SHA-256 of the text; equal rows stand together; a null conversation id is a
conversation. Other columns are not read; an empty table gives an empty report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import WS, written

NEVER = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar: state and role initial to next state. 0 nothing yet, 1 after s, 2 after u, 3 after a.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, NEVER, NEVER, 0)
STATES, INSERTS = range(4), 2
SEGMENT = 12  # bits of a row's number: 4096 rows


def _arcs(symbol: str | None, inserted: int, state: int) -> Iterator[tuple[str, int, int, int, int]]:
    """Arcs of the composition out of a state: label, cost, rows read, inserts in this place, grammar state.

    Symbols: s u a o (any other role), capital where the text is truncated, d where the row must go.
    """
    if symbol == "d":
        yield "D", 0, 1, 0, state  # counted apart, once for each of the row's copies
    elif symbol is not None:
        yield "D", DELETE, 1, 0, state
    if inserted < INSERTS:
        for role in "ua":
            if (state, role) in GRAMMAR:
                yield "I", INSERT, 0, inserted + 1, GRAMMAR[state, role]
    if symbol is not None and symbol != "d":
        role, more = symbol.lower(), TRUNCATED * symbol.isupper()
        if (state, role) in GRAMMAR:
            yield "K", KEEP + more, 1, 0, GRAMMAR[state, role]
        for to in "ua":
            if (state, to) in GRAMMAR:
                yield "R", REROLE + more, 1, 0, GRAMMAR[state, to]


def _to_go(symbols: str, end: tuple[int, ...]) -> list[list[list[int]]]:
    """Least cost from (row, inserts, grammar state) to the end, whose costs by grammar state are given. Composed states in reverse topological order."""
    n = len(symbols)
    out = [[list(end) for _ in range(INSERTS + 1)] for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for k in range(INSERTS, -1, -1):
            out[i][k] = [min((c + out[i + r][k2][g2] for _, c, r, k2, g2 in _arcs(symbols[i], k, g)), default=NEVER) for g in STATES]
    return out


def _finish() -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost and labels from each grammar state to acceptance by inserting alone."""

    def best(k: int, g: int) -> tuple[int, str]:
        return min([(ACCEPTED[g], ""), *((c + best(k2, g2)[0], label + best(k2, g2)[1]) for label, c, _, k2, g2 in _arcs(None, k, g))])

    found = [best(0, g) for g in STATES]
    return tuple(c for c, _ in found), tuple(s for _, s in found)


FINISH, LAST = _finish()


@lru_cache(maxsize=50_000)
def summary(symbols: str) -> tuple[int, ...]:
    """Costs of a segment from every grammar state to every other, row by row."""
    ends = [_to_go(symbols, tuple(0 if g == q else NEVER for g in STATES))[0][0] for q in STATES]
    return tuple(min(ends[q][p], NEVER) for p in STATES for q in STATES)


@lru_cache(maxsize=50_000)
def walk(symbols: str, end: tuple[int, ...], state: int) -> tuple[tuple[str, ...], int, int]:
    """Labels of each symbol (inserts before it included), the grammar state after, and the cost."""
    cost = _to_go(symbols, end)
    labels, i, k, g, now, total = [], 0, 0, state, "", 0
    while i < len(symbols):
        label, c, r, k2, g2 = min(a for a in _arcs(symbols[i], k, g) if a[1] + cost[i + a[2]][a[3]][a[4]] == cost[i][k][g])
        now, total = now + label, total + c
        i, k, g = i + r, k2, g2
        if r:
            labels.append(now)
            now = ""
    return tuple(labels), g, total


def before(matrix: tuple[int, ...], end: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a segment, from those after it; counted from the least, as only differences matter."""
    v = [min(min(matrix[4 * p + q] + end[q] for q in STATES), NEVER) for p in STATES]
    least = min(v)
    return tuple(min(x - least, NEVER) if x < NEVER else NEVER for x in v)


def faults(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The distinct rows in order, stored: sid (order over all), conv_id, turn, role, text, copies, and what the faults need."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    units = rows.select(F.col(id_col).alias("conv_id"), "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))
    units = units.withColumn("digest", F.unhex(F.sha2("text", 256))).groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    units = written(units, "turns")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    return written(units.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("sid", F.monotonically_increasing_id()), "sorted-turns")


def _segments(ordered: DataFrame) -> DataFrame:
    """One row a conversation and segment: symbols in order, and what it adds to the report."""
    bare = F.rtrim(F.col("text"), F.lit(WS))
    blank = bare == ""
    narrow = ordered.select("conv_id", "turn", "role", "digest", "copies", "sid", blank.alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    firsts = narrow.groupBy("conv_id", "role", "digest").agg(F.min("sid").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    r = narrow.join(firsts, same(narrow, firsts, "conv_id", "role", "digest"), "left").select(narrow["*"], F.coalesce(narrow["sid"] > F.col("first"), F.lit(False)).alias("again"))
    initial = F.substring("role", 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    gone = F.col("blank") | F.col("again")
    # copies of a kept row are duplicates of it; all copies of a row that goes go
    forced = F.when(gone, F.col("copies")).otherwise(F.col("copies") - 1)
    symbol = F.when(gone, F.lit("d")).otherwise(F.concat(F.when(F.col("cut"), F.upper(own)).otherwise(own), F.when(F.col("copies") > 1, F.lit("d")).otherwise(F.lit(""))))
    r = r.select("conv_id", F.shiftright("sid", SEGMENT).alias("block"), "sid", "turn", initial.alias("initial"), "copies", symbol.alias("symbol"), forced.alias("forced"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"), F.when(F.col("blank"), 0).otherwise(forced).alias("duplicate"), (~gone & F.col("cut")).cast("long").alias("truncated"))
    s = r.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("sid", "symbol", "initial", "copies", "turn"))).alias("rows"), *[F.sum(c).alias(c) for c in ("forced", "blank", "duplicate", "truncated")], F.min("turn").alias("low"), F.max("turn").alias("high"))
    pair = F.array(F.lit("su"), F.lit("ua"), F.lit("au"))
    rows = F.col("rows")
    neighbours = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x, i: F.concat(F.element_at(rows, i + 1)["initial"], x["initial"]))
    repeated = F.aggregate(rows, F.lit(0).cast("long"), lambda n, x: n + x["copies"] - 1)
    illegal = F.size(F.filter(neighbours, lambda p: ~F.array_contains(pair, p))) + repeated
    return s.select("conv_id", "block", F.transform(rows, lambda x: x["sid"]).alias("sids"), F.transform(rows, lambda x: x["symbol"]).alias("row_symbols"), F.array_join(F.transform(rows, lambda x: x["symbol"]), "").alias("symbols"),
        rows[0]["initial"].alias("opens"), F.element_at(rows, -1)["initial"].alias("closes"), illegal.alias("illegal"), "forced", "blank", "duplicate", "truncated", "low", "high", F.size(F.array_distinct(F.filter(F.transform(rows, lambda x: x["turn"]), lambda t: t.isNotNull()))).alias("turns"))


def _report(segments: DataFrame) -> DataFrame:
    """Counts a conversation: sums of its segments and what happens at their borders (a small row a segment)."""
    part = F.array_sort(F.collect_list(F.struct("block", "opens", "closes", "low", "high")))
    r = segments.groupBy("conv_id").agg(part.alias("parts"), *[F.sum(c).alias(c) for c in ("illegal", "forced", "blank", "duplicate", "truncated", "turns")], F.min("low").alias("low"), F.max("high").alias("high"))
    p = F.col("parts")
    borders = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: F.struct(F.concat(F.element_at(p, i + 1)["closes"], x["opens"]).alias("pair"), F.coalesce(F.element_at(p, i + 1)["high"] == x["low"], F.lit(False)).alias("same")))
    wrong = F.size(F.filter(borders, lambda b: ~b["pair"].isin("su", "ua", "au")))
    gaps = F.col("high") - F.col("low") + 1 - (F.col("turns") - F.size(F.filter(borders, lambda b: b["same"])))
    return r.select("conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + wrong).cast("long").alias("illegal"), "forced")


_STATES, _COSTS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
_FOUND = T.StructType([T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("state", T.IntegerType()), T.StructField("cost", T.LongType())])


@F.pandas_udf(_COSTS)
def _summaries(symbols: pd.Series) -> pd.Series:
    return symbols.map(lambda s: list(summary(s)))


@F.pandas_udf(T.ArrayType(_COSTS))
def _ends(matrices: pd.Series) -> pd.Series:
    """Costs to the end after each of a conversation's segments, from the last to the first."""

    def one(ms: list) -> list[list[int]]:
        out = [FINISH]
        for m in reversed(list(ms)[1:]):
            out.append(before(tuple(m), out[-1]))
        return [list(v) for v in reversed(out)]

    return matrices.map(one)


@F.pandas_udf(_STATES)
def _exits(symbols: pd.Series, end: pd.Series) -> pd.Series:
    def one(s: str, e: tuple[int, ...]) -> list[int]:
        m = summary(s)
        return [walk(s, e, g)[1] if min(m[4 * g + q] + e[q] for q in STATES) < NEVER else -1 for g in STATES]

    return pd.Series([one(s, tuple(e)) for s, e in zip(symbols, end, strict=True)])


@F.pandas_udf(_STATES)
def _entries(exits: pd.Series) -> pd.Series:
    """The grammar state before each of a conversation's segments."""

    def one(xs: list) -> list[int]:
        out = [0]
        for x in list(xs)[:-1]:
            out.append(int(x[out[-1]]))
        return out

    return exits.map(one)


@F.pandas_udf(_FOUND)
def _labels(symbols: pd.Series, parts: pd.Series, end: pd.Series, state: pd.Series) -> pd.DataFrame:
    """Labels by row (a row may have two symbols: itself and its copies); the deletions that must be are small letters."""
    out = []
    for s, p, e, g in zip(symbols, parts, end, state, strict=True):
        labels, last, cost = walk(s, tuple(e), int(g))
        labels = [x.replace("D", "d") if c == "d" else x for c, x in zip(s, labels, strict=True)]
        at, rows = 0, []
        for x in p:
            rows.append("".join(labels[at : at + len(x)]))
            at += len(x)
        out.append((rows, last, cost))
    return pd.DataFrame(out, columns=["labels", "state", "cost"])


def _solved(segments: DataFrame) -> DataFrame:
    """segments with labels, state and cost. Conversations of one segment, nearly all, need no border costs."""
    many = written(segments.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("block").alias("last")).where("n > 1").select(F.col("conv_id").alias("c"), "last"), "long-conversations")
    end = F.array(*[F.lit(x).cast("long") for x in FINISH])
    joined = segments.join(many, segments["conv_id"].eqNullSafe(many["c"]), "left")
    single = joined.where("last is null").select(segments["*"], end.alias("end"), F.lit(0).alias("entry"))
    long = joined.where("last is not null").select(segments["*"])
    if many.isEmpty():
        return single.withColumn("found", _labels("symbols", "row_symbols", "end", "entry"))
    long = written(long.withColumn("matrix", _summaries("symbols")), "segments")

    def chained(df: DataFrame, value: str, fold, out: str) -> DataFrame:
        """Fold a column over the segments of a conversation, in order, and give each its own result."""
        listed = F.array_sort(F.collect_list(F.struct("block", value)))
        got = df.groupBy("conv_id").agg(listed.alias("parts")).select("conv_id", F.transform("parts", lambda x: x["block"]).alias("blocks"), fold(F.transform("parts", lambda x: x[value])).alias("values"))
        got = got.select(F.col("conv_id").alias("c"), F.inline(F.arrays_zip("blocks", "values"))).withColumnsRenamed({"blocks": "b", "values": out})
        return df.join(got, df["conv_id"].eqNullSafe(got["c"]) & (df["block"] == got["b"])).select(df["*"], out)

    long = chained(long, "matrix", _ends, "end").drop("matrix")
    long = written(long.withColumn("exits", _exits("symbols", "end")), "segments")
    long = chained(long, "exits", _entries, "entry").drop("exits")
    return single.unionByName(long).withColumn("found", _labels("symbols", "row_symbols", "end", "entry"))


def _expected(state: int) -> str:
    return "assistant" if state == 2 else "user"


def _apply(marks: str, copies: int, role: str, text: str, state: int) -> tuple[str, list[str], int]:
    """A row's edits (d for all of its copies that must go), the rows it leaves, the grammar state after."""
    audit, rows = [], []
    for m in marks:
        if m == "d":
            m = "D" * (copies if marks[0] == "d" else copies - 1)
        elif m in "IR":
            rows.append(f"{_expected(state)}:{text if m == 'R' else ''}")
            state = 3 if state == 2 else 2
        elif m == "K":
            rows.append(f"{role}:{text}")
            state = GRAMMAR[state, role[0]]
        audit.append(m)
    return "".join(audit), rows, state


def repair(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ordered = faults(rows, id_col)
    solved = written(_solved(_segments(ordered)), "solved-turns")
    report = _report(solved)
    cost = solved.groupBy("conv_id").agg((F.sum("found.cost") + DELETE * F.sum("forced")).alias("cost"))
    labels = solved.select("conv_id", F.inline(F.arrays_zip("sids", "found.labels"))).toDF("conv_id", "sid", "label")
    # text rows and their labels meet in the order of their numbers, without a join; labels first
    none = lambda kind: F.lit(None).cast(kind)
    both = labels.select("conv_id", "sid", "label", none("string").alias("role"), none("string").alias("text"), none("long").alias("copies"))
    both = both.unionByName(ordered.select("conv_id", "sid", none("string").alias("label"), "role", "text", "copies"))
    both = both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "sid", F.col("label").asc_nulls_last())
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, label, state, any_row, audit, left = None, "", 0, False, [], None
        keys: list = []
        done: list[tuple] = []

        def line(text: str) -> None:
            nonlocal any_row
            left.update((("\n" if any_row else "") + text).encode("utf-8", "surrogatepass"))
            any_row = True

        def close() -> None:
            tail, more, _ = _apply(LAST[state], 0, "", "", state)
            for x in more:
                line(x)
            done.append((now[0], "".join(audit) + tail, left.hexdigest(), 3 * len(tail)))

        for b in batches:
            out_type = b.schema.field(0).type
            cols = [c.to_pylist() for c in b.columns]
            for conv, _, mark, role, text, copies in zip(*cols, strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now, state, any_row, audit, left = (conv,), 0, False, [], hashlib.sha256()
                if mark is not None:
                    label = mark
                    continue
                marks, more, state = _apply(label, copies, role, text, state)
                for x in more:
                    line(x)
                audit.append(marks)
            if len(done) >= 5000:
                keys, done = done, []
                yield _done_batch(keys, out_type)
        if now is not None:
            close()
            yield _done_batch(done, out_type)

    streamed = both.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string, tail_cost long")
    on = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    out = report.join(cost, on(report, cost)).join(streamed, on(report, streamed))
    return out.select(report["conv_id"].alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", (F.col("cost") + F.col("tail_cost")).alias("cost"), "audit", "repaired_sha256")


def _done_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["conv_id", "audit", "repaired_sha256", "tail_cost"])


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of `conv_id:turn`: dropped, emptied, without stops, repeated or of another role."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    text: Column = F.coalesce(F.col("text"), F.lit(" "))
    text = F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("case") == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" ")))
    return conversations.select("conv_id", "turn", "role", "text", case.alias("case")).where("case <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("case") == 3, 2).otherwise(1).alias("copies"))
