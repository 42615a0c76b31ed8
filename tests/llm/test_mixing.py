"""Mixing by the cube method: targets against repeated resharing, and balance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing, queries


def fill(size, weights=(5, 2, 1), cap=3.0):
    """Targets by repeated resharing of what caps cut off; sources by code point, null last."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    done, left, total = {}, set(size), sum(size.values())
    while left:
        level = (total - sum(done.values())) / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > cap * size[s]}
        if not over:
            return done | {s: level * w[s] for s in left}
        done |= {s: cap * size[s] for s in over}
        left -= over
    return done


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, "d": 10, "e": 10, None: 7}, {"a": 1, "b": 1000, "c": 5, "d": 1}, {"a": 0, "b": 0}, {"z": 4}, {"a": 6, "b": 30, "c": 6, "d": 6, "é": 6, "Z": 30}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 400):
        p, s = rng.random(n), rng.integers(0, 100, n).astype(float)
        q = mixing.flight(p, s, np.random.default_rng(1))
        assert ((q > 0) & (q < 1)).sum() <= 2
        if n > 3:
            assert abs(q.sum() - p.sum()) < 1e-3 and abs((q * s).sum() - (p * s).sum()) < 0.1
        z = mixing.land(q, s)
        assert set(z.tolist()) <= {0.0, 1.0}


def test_flight_is_unbiased():
    p, s = np.full(6, 0.5), np.array([1.0, 2, 3, 4, 5, 6])
    mean = np.mean([mixing.flight(p, s, np.random.default_rng(k)) for k in range(600)], axis=0)
    assert np.abs(mean - 0.5).max() < 0.08


def test_query(spark, sf):
    out = queries.op1_mix_sources(spark, sf)
    rows = out.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op1_mix_sources(spark, sf).collect()))
    size, taken, longest = {}, {}, {}
    for r in rows:
        s = r["source"]
        size[s], taken[s], longest[s] = size.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], max(longest.get(s, 0), r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    want = fill(size)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in size)


def test_defined_cases(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (None, "d e", None), (3, "", "x"), (4, "w " * 20000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(9)).withColumn("size", F.lit("s"))
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == mixing.mix(df).count()
    assert mixing.mix(df.limit(0)).count() == 0
    small = mixing.mix_plan(spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), (F.col("id") % 50).alias("size")), shard_docs=8)
    assert small.count() == 300
    got = {r["source"]: (r["t"], r["target"]) for r in small.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
    assert all(abs(t - target) <= 50 for t, target in got.values())


def test_null_ids_leave_large_ids_whole(spark):
    ids = [2**53 + 1 + k for k in range(8)] + [None, None]
    df = spark.createDataFrame([(i, "x", 10 + k) for k, i in enumerate(ids)], "doc_id long, source string, size long")
    assert sorted(str(r["doc_id"]) for r in mixing.mix_plan(df).collect()) == sorted(map(str, ids))
    text = spark.createDataFrame([(i, "w " * (k + 1), "ab"[k % 2]) for k, i in enumerate(ids)], "doc_id string, text string, source string")
    assert {r["doc_id"] for r in mixing.mix(text).collect()} <= {str(i) if i else None for i in ids}


def test_repeated_keys_share_their_copies(spark):
    """A third of all rows with one key: few units fly, and no row gets more than its share."""
    rows = [(None, "a", 7)] * 400 + [(k, "ab"[k % 2], k % 40) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    assert mixing.mix_units(df, shard_docs=16).where("m > 1").count() == 1
    plan = mixing.mix_plan(df, shard_docs=16).collect()
    assert sorted((str(r["doc_id"]), r["source"], r["size"]) for r in plan) == sorted((str(i), s, n) for i, s, n in rows)
    hot = [r["copies"] for r in plan if r["doc_id"] is None]
    assert max(hot) - min(hot) <= 1
    for s in "ab":
        mine = [r for r in plan if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 40
    texts = spark.createDataFrame([(i, f"{'w ' * n}" if i is not None else "t " * n, s, str(k % 5)) for k, (i, s, n) in enumerate(rows)], "doc_id long, text string, source string, other string")
    got = mixing.mix(texts, shard_docs=16)
    assert got.where("doc_id is null").count() == sum(hot)
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(texts.repartition(7), shard_docs=16).collect()))
