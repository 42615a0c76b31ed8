"""Ordered folds against plain Python."""

import random
from decimal import ROUND_HALF_UP, Decimal

from sparkloom.operators import accounting, quota


def test_folds_hold_no_user_in_one_row(spark):
    """One user with a third of all rows, in Arrow batches far smaller than that: the same fold, and nothing collected."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), rng.choice([None, *range(400)]), x, rng.randrange(2000), rng.random() / 1e4) for x in range(600)]
    log = spark.createDataFrame(rows, "u long, ms long, x long, lat long, cost double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        q, m = quota.quota_fold(log, "u", "ms", "x", 3, 30), accounting.session_metrics_exact(log, "u", ["ms", "x"], "cost", "lat")
        assert not any("collect_list" in d._jdf.queryExecution().toString() for d in (q, m))
        got_q, got_m = {r["u"]: r for r in q.collect()}, {r["u"]: r for r in m.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    users = {r[0] for r in rows}
    assert set(got_q) == set(got_m) == users
    for u in users:
        count, last, asked, fresh, avg, cost = 0, None, 0, 0, 0, Decimal(0)
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for n, (_, t, _, lat, c) in enumerate(mine):
            new = count >= 3 and None not in (t, last) and t - last >= 30
            count = 0 if new else count
            if count < 3:
                count, last, asked, fresh = count + 1, t, asked + 1, fresh + (new or asked == 0)
            avg = (avg * n + lat) // (n + 1)
            cost = Decimal(repr(float(cost) + c)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        assert tuple(got_q[u]) == (u, asked, len(mine) - asked, fresh, count)
        assert tuple(got_m[u]) == (u, len(mine), cost, avg)
