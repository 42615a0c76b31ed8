"""The search over pairs of blocks: what it shuffles, its ties, and answers whose prompts pass in slices."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom import models
from sparkloom.functions import vector as V
from sparkloom.operators import retrieval
from sparkloom.plans import answering


def shuffled(spark):
    """Bytes that all jobs so far have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_shuffles_grow_with_the_tables_not_with_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE_NUMBERS", 4096)
    monkeypatch.setattr(retrieval, "TILE_QUESTIONS", 32)
    rng, wrote = np.random.default_rng(3), []
    for n in (1, 1, 4):  # the first run settles what runs once
        rows = [("a", k, None, "t", "d", v) for k, v in enumerate(rng.normal(size=(1000 * n, 16)).tolist())]
        c = spark.createDataFrame(rows, "type string, id long, child_id long, title string, description string, embedding array<float>")
        q = spark.createDataFrame(list(enumerate(rng.normal(size=(250 * n, 16)).tolist())), "query_id long, query_embedding array<float>")
        before = shuffled(spark)
        assert retrieval.search_many(c, q, 3).where("rank = 3").count() == 250 * n
        wrote.append(shuffled(spark) - before)
    assert wrote[2] < 5 * wrote[1]  # 16 times the pairs of blocks


@pytest.mark.parametrize("number", ["float", "double"])
def test_ties_and_near_ties_over_many_blocks(spark, monkeypatch, number):
    monkeypatch.setattr(retrieval, "TILE_NUMBERS", 64)
    monkeypatch.setattr(retrieval, "TILE_QUESTIONS", 5)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8))
    x[40:90] = x[40]  # copies in many blocks
    x[90:140] = x[40] * (1 + 1e-7 * rng.normal(size=(50, 8)))  # told apart by the last bits alone
    kinds = [None, "a", "é", "b"]
    rows = [(kinds[k % 4], None if k % 11 == 0 else k % 9, None if k % 3 else k % 7, f"t{k}", "d", v) for k, v in enumerate(x.tolist())]
    c = spark.createDataFrame(rows, f"type string, id long, child_id long, title string, description string, embedding array<{number}>").coalesce(1)
    q = spark.createDataFrame([(k // 2, v) for k, v in enumerate([*rng.normal(size=(20, 8)).tolist(), x[40].tolist(), x[100].tolist()])], f"query_id long, query_embedding array<{number}>")
    j = c.withColumn("at", F.monotonically_increasing_id()).crossJoin(q)
    j = j.withColumn("score", V.cosine(V.dot(F.col("embedding"), F.col("query_embedding")), V.norm(F.col("embedding")) * V.norm(F.col("query_embedding"))))
    # two questions have one id: their hits are ranked together
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "type", "id", F.col("child_id").asc_nulls_first(), "at")
    want = j.withColumn("rank", F.row_number().over(best)).where("rank <= 30")
    show = lambda t: sorted(map(repr, t.select("query_id", "type", "id", "child_id", "score", "rank").collect()))
    assert show(retrieval.search_many(c, q, 30)) == show(want)


def test_prompts_in_slices_give_the_same_answers(spark, monkeypatch):
    e = models.HashEmbedder(8)
    docs = models.embed_texts(spark.createDataFrame([(k, f"w{k % 30}") for k in range(60)], "id int, t string"), "t", e)
    corpus = retrieval.corpus(docs, "formation", F.col("id"), F.col("t"), F.col("t"))
    q = spark.createDataFrame([(f"q{k % 11}", "s", f"w{k}") for k in range(40)], "query_id string, session_id string, query_text string").withColumn("created_at", F.current_timestamp())
    prices = spark.createDataFrame([("template", 1.0)], "model string, price double")
    said = []
    for slices in (1 << 16, 3):
        monkeypatch.setattr(answering, "PROMPTS", slices)
        a = answering.answer(q, corpus, prices, e, [models.TemplateGenerator()], settings=answering.Settings(threshold=0.7, top_k=4))
        said.append([sorted(map(repr, t.collect())) for t in (a.answered.select("query_id", "query_text", "user", "response", "tokens_used", "cost"), a.log.select("query_id", "query_text", "retrieved_chunks", "llm_tokens"))])
    assert said[0] == said[1] and len(said[0][0]) == len(said[0][1]) == 40


def test_the_log_needs_no_prompts(spark):
    e = models.HashEmbedder(8)
    docs = models.embed_texts(spark.createDataFrame([(1, "hello")], "id int, t string"), "t", e)
    corpus = retrieval.corpus(docs, "formation", F.col("id"), F.col("t"), F.col("t"))
    q = spark.createDataFrame([("1", "s", "hello")], "query_id string, session_id string, query_text string").withColumn("created_at", F.current_timestamp())
    a = answering.answer(q, corpus, spark.createDataFrame([("template", 1.0)], "model string, price double"), e, [models.TemplateGenerator()])
    for t in (a.log, a.answered.drop("context", "system", "user")):
        assert "description" not in t._jdf.queryExecution().executedPlan().toString()
