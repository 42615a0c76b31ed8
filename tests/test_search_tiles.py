"""The tiled search against the plain expression, with vectors that the tiles do not take."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import vector as V
from sparkloom.operators import retrieval

CORPUS = "type string, id long, child_id long, title string, description string, embedding array<double>"
ASKED = "query_id long, query_embedding array<double>"


def expected(c, q, k):
    j = c.where("embedding is not null").crossJoin(q.where("query_embedding is not null"))
    j = j.withColumn("score", V.cosine(V.dot(F.col("embedding"), F.col("query_embedding")), V.norm(F.col("embedding")) * V.norm(F.col("query_embedding"))))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "type", "id", F.col("child_id").asc_nulls_first())
    return shown(j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def shown(df):
    return sorted(map(repr, df.select("query_id", "type", "id", "child_id", "title", "score", "rank").collect()))


def tables(spark, odd):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(30, 8))
    x[50:120] = x[50]
    vectors, questions = x.tolist(), [*q.tolist(), x[50].tolist()]
    if odd:
        # 1e-170: squares vanish; 1e160: squares overflow
        for v in ([0.0] * 8, [0.0] * 8, None, [], [1.0] * 3, [math.nan] * 8, [math.inf] * 8, [1.0, None] * 4, [1e-170] * 8, [1e160] * 8):
            vectors.insert(7, v)
            questions.append(v)
    rows = [("ab"[k % 2], k, None if k % 3 else k % 7, f"t{k}", "d" * 50, v) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, CORPUS), spark.createDataFrame(list(enumerate(questions)), ASKED)


def test_same_as_the_plain_expression(spark, monkeypatch):
    for odd in (False, True):
        c, q = tables(spark, odd)
        for k in (1, 9):
            want = expected(c, q, k)
            assert shown(retrieval.search_many(c, q, k)) == want
            with monkeypatch.context() as m:  # many tiles, and questions of the plain expression in blocks
                m.setattr(retrieval, "TILE_NUMBERS", 256)
                m.setattr(retrieval, "TILE_QUESTIONS", 4)
                assert shown(retrieval.search_many(c, q, k, broadcast_rows=8)) == want


def test_no_pairs_are_rows_of_a_join(spark):
    c, q = tables(spark, False)
    plan = retrieval.search_many(c, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapGroupsInArrow" in plan


def test_empty_sides(spark):
    c, q = tables(spark, False)
    assert retrieval.search_many(c.where("id < 0"), q, 3).count() == 0
    assert retrieval.search_many(c, q.where("query_id < 0"), 3).count() == 0
