"""Hot keys in segments against the folds, which walk them in one task."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import accounting, quota, segments


def events(seed, n=3000, nulls=0, step=40):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        u = rnd.choice([1, 1, 2, 3, 4, None])
        rows.append((u, None if k < nulls else rnd.randrange(n * step), k))
    return rows


def both(a, b):
    x, y = ({r[0]: tuple(r)[1:] for r in d.collect()} for d in (a, b))
    assert x == y
    return x


@pytest.mark.parametrize(("cooldown", "block", "nulls", "step"), [(100, 64, 0, 40), (100, 64, 2, 40), (5_000, 50, 0, 40), (0, 64, 0, 2), (1, 200, 4, 1), (10**7, 64, 0, 40), (300, 3, 0, 40)])
def test_quota(spark, cooldown, block, nulls, step):
    """Dense and sparse times, ties, nulls, cooldowns shorter and longer than a segment's span and than all."""
    df = spark.createDataFrame(events(cooldown + block, nulls=nulls, step=step), "u long, ms long, x long")
    got = both(segments.quota_split(df, "u", "ms", "x", 3, cooldown, hot_rows=400, block_rows=block), quota.quota_fold(df, "u", "ms", "x", 3, cooldown))
    assert len(got) == 5


def test_quota_of_one_burst_then_silence(spark):
    rows = [(1, 10, k) for k in range(500)] + [(1, 10_000 + 7 * k, 1000 + k) for k in range(500)] + [(1, 10**9, 5000)]
    df = spark.createDataFrame(rows, "u long, ms long, x long")
    for n in (1, 2, 5):
        both(segments.quota_split(df, "u", "ms", "x", n, 100, hot_rows=10, block_rows=64), quota.quota_fold(df, "u", "ms", "x", n, 100))
    assert segments.quota_split(df.limit(0), "u", "ms", "x", 3, 100).count() == 0


def test_a_hot_user_is_the_work_of_several_tasks(spark):
    df = spark.createDataFrame(events(3), "u long, ms long, x long").repartition(4)
    p = segments.positions(df, "u", ["ms", "x"]).where("u = 1")
    tasks = p.withColumn("_t", F.floor(F.col("_pos") / 64)).groupBy("_t").count()
    assert tasks.count() > 10 and tasks.agg(F.max("count")).first()[0] <= 64
    assert [r["_pos"] for r in p.orderBy("_pos").collect()] == list(range(p.count()))


def turns(seed, n=2500, exact=False):
    rnd = random.Random(seed)
    cost = lambda: rnd.choice([0.5e-6, 1.5e-6, 2.5e-6, 0.0000125, 0.1234565]) if exact else rnd.random() / 1e3
    return [(rnd.choice([1, 1, 2, 3, None]), rnd.randrange(10_000), k, rnd.randrange(3000), cost()) for k in range(n)]


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("block", [64, 1000])
def test_metrics(spark, exact, block):
    """With costs anywhere, and with all of them at a half of the last decimal."""
    df = spark.createDataFrame(turns(block, exact=exact), "s long, t long, x long, lat long, c double")
    got = both(segments.metrics_split(df, "s", ["t", "x"], "c", "lat", hot_rows=300, block_rows=block), accounting.session_metrics_exact(df, "s", ["t", "x"], "c", "lat"))
    assert len(got) == 4


def test_metrics_with_nulls_and_widths(spark):
    rows = turns(9)
    rows[100] = (1, 5, 100, None, 0.1)
    rows[200] = (2, 5, 200, 7, None)
    rows += [(3, 1, 10**6, 10**12, 0.1)]  # too wide for a table
    df = spark.createDataFrame(rows, "s long, t long, x long, lat long, c double")
    got = both(segments.metrics_split(df, "s", ["t", "x"], "c", "lat", hot_rows=300, block_rows=100), accounting.session_metrics_exact(df, "s", ["t", "x"], "c", "lat"))
    assert got[1][2] is None and got[2][1] is None
    assert segments.metrics_split(df.limit(0), "s", ["t", "x"], "c", "lat").count() == 0


def test_totals_out_of_range(spark):
    df = spark.createDataFrame([(1, k, k, 5, 300.0) for k in range(60)], "s long, t long, x long, lat long, c double")
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        assert both(segments.metrics_split(df, "s", ["t", "x"], "c", "lat", hot_rows=10, block_rows=16), accounting.session_metrics_exact(df, "s", ["t", "x"], "c", "lat"))[1][1] is None
        spark.conf.set("spark.sql.ansi.enabled", "true")
        with pytest.raises(Exception, match="out of the range"):
            segments.metrics_split(df, "s", ["t", "x"], "c", "lat", hot_rows=10, block_rows=16).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_tables_of_means():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        lat = rnd.integers(100, 400, 300)
        begins, ends = segments.mean_table(lat, n, 100, 399)
        for start in range(100, 400, 13):
            avg = start
            for k, one in enumerate(lat.tolist()):
                avg = one if n + k == 0 else (avg * (n + k) + one) // (n + k + 1)
            assert ends[int(np.searchsorted(begins, start, "right")) - 1] == avg


def test_summaries_of_costs():
    rnd = random.Random(2)
    costs = [rnd.choice([rnd.random(), 0.5e-6, 1e-7, -0.25e-5, 0.1 + 0.5e-6]) for _ in range(400)]
    total = Decimal(0)
    for c in costs:
        total = accounting.turn((0, total, None), None, c)[1]
    s = segments._cost_summary(np.array(costs))
    assert segments._cost_after(Decimal(0), s["gaps"], s["lows"], s["highs"], s["costs"], True) == total and 0 < len(s["costs"]) < 400


def test_summaries_compose(spark, monkeypatch):
    """Summaries in a row as one: the task that ends a session reads `WIDE` at most, with the same row."""
    rng = np.random.default_rng(8)
    rows = [("hot", k, int(rng.integers(50, 90)), float(rng.integers(0, 10**6)) / 1e6 + (0.5e-6 if k % 7 == 0 else 0.0)) for k in range(1500)]
    rows += [("none", k, None if k == 70 else 3, None if k == 90 else 0.25) for k in range(400)]
    log = spark.createDataFrame(rows, "s string, at long, l long, c double")
    want = sorted(map(tuple, accounting.session_metrics_exact(log, "s", ["at"], "c", "l").collect()))
    monkeypatch.setattr(segments, "WIDE", 4)
    read, fold = [], segments.ordered_fold
    monkeypatch.setattr(segments, "ordered_fold", lambda parts, *a: read.append(parts.groupBy("s").count().agg({"count": "max"}).first()[0]) or fold(parts, *a))
    got = segments.metrics_split(log, "s", ["at"], "c", "l", hot_rows=100, block_rows=16)
    assert sorted(map(tuple, got.collect())) == want
    assert read and read[0] <= 4
