"""Inserts in as many tasks as their rows need."""

from sparkloom.operators import merge


def test_tasks_grow_with_the_rows(spark):
    new = spark.range(1000).selectExpr("id % 300 as k", "id % 2 as l")
    old = new.where("k % 3 = 0").distinct()
    got = merge.insert_ignore(old, new, ["k", "l"], task_rows=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, new.distinct().collect()))
    assert "hashpartitioning(k" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 20)" in plan
