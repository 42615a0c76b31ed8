"""Session rows kept up to date bucket by bucket.

The log and the session rows are partitioned by a hash of the session. An append writes its
turns, then computes anew only the buckets it touched, from their whole logs: exact whatever
the order of the turns, and a fraction of the work where appends are small. Buckets that no
turn touched keep their files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import accounting

TURNS = "session_id long, ts timestamp_ntz, event_id long, tokens long, latency long, cost double, provider string"
ROWS = "session_id long, question_count long, total_tokens long, total_cost decimal(10,6), avg_latency_ms long, providers_used map<string,bigint>"


def bucket(session: str, n: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(n)).cast("int")


def append(turns: DataFrame, path: str, buckets: int = 256) -> list[int]:
    """Add turns (TURNS) to the log below path and renew the rows of the sessions' buckets; returns these buckets.

    A log keeps its number of buckets. If a run fails between log and rows, renew() with its buckets (or all) mends it.
    """
    spark = turns.sparkSession
    held = turns.select(*[x.split()[0] for x in TURNS.split(", ")]).withColumn("bucket", bucket("session_id", buckets)).persist()
    try:
        touched = [r["bucket"] for r in held.select("bucket").distinct().orderBy("bucket").collect()]
        held.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/log")
    finally:
        held.unpersist()
    renew(spark, path, touched)
    return touched


def renew(spark: SparkSession, path: str, buckets: list[int] | None = None) -> None:
    """Compute the session rows of these buckets (all, if none are named) from the log."""
    log = spark.read.schema(f"{TURNS}, bucket int").parquet(f"{path}/log")
    if buckets is not None:
        if not buckets:
            return
        log = log.where(F.col("bucket").isin(buckets))
    n = log.select("session_id", "bucket").distinct()
    rows = accounting.session_rows(log, "session_id", ["ts", "event_id"], "tokens", "cost", "latency", "provider")
    rows = rows.join(n, rows["session_id"].eqNullSafe(n["session_id"])).select(rows["*"], "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/sessions")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ROWS}, bucket int").parquet(f"{path}/sessions").drop("bucket")
