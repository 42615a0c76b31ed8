"""Pruned search against the plain search over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import pruned, retrieval

CORPUS = "type string, id long, child_id long, title string, description string, embedding array<float>"
ASKED = "query_id long, query_embedding array<float>"


def corpus(spark, x, repeats=1):
    rows = [("ab"[k % 2], k // repeats, None if k % 3 else k % 7, f"t{k}", None, [float(a) for a in v]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, CORPUS)


def asked(spark, q):
    return spark.createDataFrame([(k, None if v is None else [float(a) for a in v]) for k, v in enumerate(q)], ASKED)


def plain(c, q, k):
    return sorted(map(repr, retrieval.search_many(c, q, k).select("query_id", "type", "id", "child_id", "title", "score", "rank").collect()))


def found(index, q, k, **options):
    return sorted(map(repr, pruned.search(index, q, k, **options).select("query_id", "type", "id", "child_id", "title", "score", "rank").collect()))


def groups(rng, n, dim, centres, spread, span=None):
    span = span or dim
    base = rng.normal(size=(centres, span)) @ np.linalg.qr(rng.normal(size=(dim, span)))[0].T
    return base[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


@pytest.mark.parametrize(("dim", "span"), [(16, None), (16, 2), (3, None), (1, None)])
@pytest.mark.parametrize("block_rows", [4096, 40])
def test_same_rows_and_scores(spark, tmp_path, dim, span, block_rows):
    rng = np.random.default_rng(dim)
    x, q = groups(rng, 600, dim, 12, 0.3, span), groups(rng, 20, dim, 12, 0.3, span)
    x[100:300] = x[100]  # a third of the rows are one vector: ties go by type, id and child
    c, a = corpus(spark, x), asked(spark, [*q, x[100]])
    index = pruned.build(c, str(tmp_path / "i"))
    for k in (1, 7):
        assert found(index, a, k, block_rows=block_rows) == plain(c, a, k)


def test_most_clusters_are_skipped(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(50, 24))
    x, q = (centres[rng.integers(0, 50, n)] + rng.normal(size=(n, 24)) * 0.05 for n in (5000, 60))
    c, a = corpus(spark, x), asked(spark, q)
    index = pruned.build(c, str(tmp_path / "i"))
    assert found(index, a, 5) == plain(c, a, 5)
    vec = a.select(F.col("query_id").alias("qid"), F.col("query_embedding").cast("array<double>").alias("q"))
    first = pruned.first_probes(index, vec, 5)
    least = retrieval.search_many(c, a, 5).groupBy("query_id").agg(F.min("score").alias("least")).withColumnRenamed("query_id", "qid")
    rest = pruned.last_probes(index, first.join(least, "qid").select("qid", "q", F.col("clusters").alias("seen"), "least"))
    rows = sum(int(index.count[c]) for df in (first, rest) for r in df.collect() for c in r["clusters"])
    assert rows < 0.1 * 60 * 5000


def test_odd_vectors(spark, tmp_path):
    zero, nan = [0.0, 0.0, 0.0], [math.nan, 1.0, 1.0]
    x = [[1.0, 2.0, 3.0], zero, [3.0, 2.0, 1.0], [-1.0, 0.0, 0.0], zero, [1.0, 2.0, 3.0]]
    c = corpus(spark, x)
    a = asked(spark, [[1.0, 2.0, 3.0], zero, None])
    odd = spark.createDataFrame([("c", 90, None, "n", "d", None), ("c", 91, None, "n", "d", [1.0]), ("c", 92, None, "n", "d", nan), ("c", 93, None, "n", "d", []), ("c", 94, None, "n", "d", [None, 1.0, 1.0])], CORPUS)
    index = pruned.build(c.unionByName(odd).withColumns({"cluster": F.lit("clash"), "row": F.lit("clash")}), str(tmp_path / "i"))
    for k in (1, 3, 10):
        assert found(index, a, k) == plain(c, a, k)
    assert found(index, asked(spark, [nan, [1.0], []]), 3) == []
    none = pruned.build(c.limit(0), str(tmp_path / "none"))
    assert found(none, a, 3) == []


def test_inserts_reach_the_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    old, new, q = groups(rng, 300, 8, 5, 0.2), groups(rng, 200, 8, 9, 0.5), groups(rng, 15, 8, 9, 0.5)
    c = corpus(spark, old)
    pruned.insert(pruned.build(c, str(tmp_path / "i")), corpus(spark, new).withColumn("type", F.lit("new")))
    a = asked(spark, q)
    both = c.unionByName(corpus(spark, new).withColumn("type", F.lit("new")))
    assert found(pruned.load(spark, str(tmp_path / "i")), a, 6) == plain(both, a, 6)


def test_scan_reads_probed_clusters_only(spark, tmp_path):
    rng = np.random.default_rng(5)
    index = pruned.build(corpus(spark, groups(rng, 400, 8, 6, 0.1)), str(tmp_path / "i"))
    plan = index.rows().where(F.col("cluster").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cluster" in plan
