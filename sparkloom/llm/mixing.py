"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words (weights shared over all words,
capped at ``max_repeat`` times the source, the excess reshared). A document is
taken floor(f) times for its source's factor f = target / size, and once more
with probability pi = f - floor(f). Which documents those are is drawn by the
cube method: the vector of probabilities moves at random within the null-space
of the balancing constraints (words and number of documents), so both totals
hold exactly until at most two fractional documents are left. The flight runs
in shards of a source; what each shard leaves is flown again together, until
one small landing problem a source remains.

Defined cases: null texts and texts without words have size 0 and are drawn
by document counts alone; a null source is a source of its own, last in
order; rows of equal id, source and size are one unit (so a null id on a
third of all rows makes no large shard), whose copies they share as evenly as
whole copies go; null ids are kept as they are; a source without words takes
none of the mix; an empty table gives an empty result. Same input, same mix:
the draw is seeded by source and shard and ordered by a hash of the key.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import n_words_of, written
from sparkloom.operators import merge

EPS = 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0) -> DataFrame:
    """One row a source: source, n_docs (rows given), source_size, target (double).

    sized has source and size, and may have m, the number of documents a row
    stands for. Sources are ranked by a distributed sort. The level of the
    targets is found by resharing: each round is one aggregate over the
    sources, and those whose cap lies below the level are at their caps from
    then on. Sums are of whole numbers, so any order of rows gives the same.
    """
    m = F.col("m") if "m" in sized.columns else F.lit(1).cast("long")
    s = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("size") * m).cast("long").alias("source_size"))
    s = merge.surrogate_keys(s, [F.col("source").asc_nulls_last()], "_rank", start=0)
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights)).cast("int"))
    s = written(s.select("source", "n_docs", "source_size", w.alias("w")), "mix-sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    ratio, level = F.lit(float(max_repeat)) * F.col("source_size") / F.col("w"), 0.0
    while True:
        free = ratio > level
        capped, w_free = s.agg(F.sum(F.when(free, 0).otherwise(F.col("source_size"))), F.sum(F.when(free, F.col("w")).otherwise(0.0))).first()
        if not w_free:
            break
        nxt = max(level, (total - max_repeat * capped) / w_free)
        if nxt == level:
            break
        level = nxt
    target = F.least(F.lit(float(max_repeat)) * F.col("source_size"), F.lit(level) * F.col("w"))
    return s.select("source", "n_docs", "source_size", target.alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase for two constraints (size and count), three units at a time.

    Returns pi with at most two entries strictly between 0 and 1; the sums of
    pi and of pi * size are kept.
    """
    p, s = pi.tolist(), size.tolist()
    draws = iter(rng.random(len(p) + 3).tolist())
    work: list[int] = []
    for k in range(len(p) + 1):
        while len(work) == 3:
            i, j, m = work
            u = (s[j] - s[m], s[m] - s[i], s[i] - s[j])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for x, d in zip(work, u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
                elif d < 0:
                    up, down = min(up, -p[x] / d), min(down, (p[x] - 1) / d)
            step = up if next(draws) * (up + down) < down else -down
            for x, d in zip(work, u, strict=True):
                v = p[x] + step * d
                p[x] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
            left = [x for x in work if 0.0 < p[x] < 1.0]
            if len(left) == 3:  # numerically stuck: settle the nearest one
                x = min(left, key=lambda y: min(p[y], 1 - p[y]))
                p[x] = float(round(p[x]))
                left.remove(x)
            work = left
        if k < len(p) and 0.0 < p[k] < 1.0:
            work.append(k)
    return np.asarray(p)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing of the few units left: the 0/1 choice nearest to the word total, then to the document total."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    best, out = None, pi.copy()
    for code in range(1 << len(open_)):
        z = np.array([code >> k & 1 for k in range(len(open_))], float)
        miss = (abs(((z - pi[open_]) * size[open_]).sum()), abs((z - pi[open_]).sum()))
        if best is None or miss < best:
            best, out[open_] = miss, z
    return out


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def mix_units(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, shard_docs: int = 1000, seed: int = 7) -> DataFrame:
    """docs (doc_id, source, size) -> doc_id, source, size, m, source_size, target, copies (long).

    A unit stands for the m rows of equal id, source and size, and copies is
    what all of them get together. shard_docs bounds what one task flies
    together; rounds over what is left go on until a source's rest fits one
    shard, so nothing unbounded meets. Ids stay Arrow values throughout.
    """
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")
    units = written(docs.select("doc_id", "source", size).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-sizes")
    stats = written(source_targets(units, weights, max_repeat), "mix-targets")
    largest = stats.agg(F.max("n_docs")).first()[0] or 0
    same = F.col("t.source").eqNullSafe(F.col("d.source"))
    due = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.alias("d").join(stats.alias("t"), same).select("doc_id", "d.source", "size", "m", "source_size", "target", "n_docs", due.alias("due"))
    whole = F.floor(F.col("due") + EPS)
    rows = rows.select("*", whole.cast("long").alias("base"), F.greatest(F.col("due") - whole, F.lit(0.0)).alias("pi"))
    rows = rows.withColumn("pi", F.when(F.col("pi") < EPS, 0.0).otherwise(F.col("pi"))).withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = rows.withColumn("shard", F.pmod("place", F.ceil(F.col("n_docs") / shard_docs))).drop("due", "n_docs")

    def fly(last: bool):
        def run(t: pa.Table) -> pa.Table:
            size, pi, place = (t.column(c).to_numpy() for c in ("size", "pi", "place"))
            rng = np.random.default_rng(_seed(seed, last, t.column("source")[0].as_py(), t.column("shard")[0].as_py(), t.num_rows))
            at = np.lexsort((size, place))
            at = at[rng.permutation(len(at))]
            p = flight(pi[at], size[at].astype(float), rng)
            if last:
                p = land(p, size[at].astype(float))
            out = np.empty(len(p))
            out[at] = p
            return t.set_column(t.column_names.index("pi"), "pi", pa.array(out))

        return run

    done, left = [], largest
    while True:
        last = left <= shard_docs
        rows = written(rows.groupBy("source", "shard").applyInArrow(fly(last), rows.schema), "mix-flight")
        if last:
            done.append(rows)
            break
        settled = (F.col("pi") == 0.0) | (F.col("pi") == 1.0)
        done.append(rows.where(settled))
        # each shard left two units at most
        rows = rows.where(~settled).withColumn("shard", F.floor(F.col("shard") * 2 / shard_docs).cast("long"))
        left = 2 * math.ceil(left / shard_docs)
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "source", "size", "m", "source_size", "target", (F.col("base") + F.col("pi").cast("long")).alias("copies"))


def _share(copies: Column, m: Column, place: Column) -> Column:
    """What row number `place` (from 0) of a unit's m rows gets of the unit's copies."""
    return F.floor(copies / m).cast("long") + (place < copies % m).cast("long")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, source, size) -> one row a document: doc_id, source, size, source_size, target, copies (long)."""
    units = mix_units(docs, **options)
    each = units.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("place"))
    return each.select("doc_id", "source", "size", "source_size", "target", _share(F.col("copies"), F.col("m"), F.col("place")).alias("copies"))


def mix(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs as often as the mix takes them: a document taken k times is there k times.

    Rows of equal id, source and size share their unit's copies; where these
    are no multiple of the rows, the first rows in the order of a hash of all
    columns get one more. Only such rows are ranked, by a distributed sort.
    """
    cols = docs.columns
    docs = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(cols)], F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words_of(F.col(text_col)).alias("_size"))
    plan = mix_units(docs.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size")), **options)
    taken = plan.where("copies > 0").select("doc_id", "source", "size", "m", "copies")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))
    j = docs.join(taken, same)
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(cols)]
    times = lambda df, n: df.select(*back, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_copy")).drop("_copy")
    uneven = F.col("copies") % F.col("m") != 0
    out = times(j.where(~uneven), F.floor(F.col("copies") / F.col("m")).cast("long"))
    if taken.where(uneven & (F.col("m") > 1)).isEmpty():
        return out
    hashed = F.xxhash64(*[F.col(f"c{k}") for k, c in enumerate(cols) if j.schema[f"c{k}"].dataType.typeName() not in ("map", "variant")])
    ranked = merge.surrogate_keys(j.where(uneven).withColumns({"_hash": hashed, "_row": F.monotonically_increasing_id()}), ["_id", "_source", "_size", "_hash", "_row"], "_place")
    first = ranked.groupBy("_id", "_source", "_size").agg(F.min("_place").alias("_first"))
    first = first.select(F.col("_id").alias("_i"), F.col("_source").alias("_s"), F.col("_size").alias("_z"), "_first")
    r = ranked.join(first, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    r = r.withColumn("_n", _share(F.col("copies"), F.col("m"), F.col("_place") - F.col("_first"))).where("_n > 0")
    return out.unionByName(times(r, F.col("_n")))
