"""Connected components over an edge table, as Spark joins.

Alternates large-star and small-star steps (a few rounds, logarithmic in the
diameter in practice). Each round is written to the shared folder, so no
lineage grows and a lost executor costs one round at most. The driver only
sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import written


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours of each node to the smallest of them (and itself)."""
    if large:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    m = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    j = both.join(m, "a")
    if large:
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b long) -> (node, component): component is the smallest node
    reachable. Nodes without an edge do not appear; loops, nulls and repeated
    edges are ignored; an empty table gives an empty result.
    """
    e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        s = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if s == last or s[0] == 0:
            break
        last = s
        e = written(_star(_star(e, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
