"""Streams against the batch operators."""

from pyspark.sql import functions as F

from sparkloom.operators import accounting, quota
from sparkloom.streaming import sessions


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def files(spark, df, path, n=3):
    """df in n files whose order follows the event order."""
    total = df.count()
    for k in range(n):
        df.where((F.col("event_id") >= k * total // n) & (F.col("event_id") < (k + 1) * total // n)).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def events(spark, sf, n=300):
    e = spark.read.parquet(f"{sf}/events.parquet").where("value is not null").orderBy("ts", "event_id").limit(n)
    rows = [(k, r["user_id"], r["ts"], abs(r["value"])) for k, r in enumerate(e.collect())]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double")


def test_session_metrics(spark, sf, tmp_path):
    e = events(spark, sf).select(F.col("user_id").alias("session_id"), "ts", "event_id", F.floor(F.col("value") * 10).cast("long").alias("latency"), (F.col("value") / 999983).alias("cost"), F.floor("value").alias("tokens"), F.concat(F.lit("p"), F.col("event_id") % 3).alias("provider"))
    out = run(sessions.session_metrics_stream(files(spark, e, str(tmp_path))), "w1", "update")
    last = out.groupBy("session_id").agg(F.max_by(F.struct("question_count", "total_tokens", "total_cost", "avg_latency_ms", "providers_used"), "question_count").alias("r")).select("session_id", "r.*")
    want = accounting.session_rows(e, "session_id", ["ts", "event_id"], "tokens", "cost", "latency", "provider")
    assert sorted((tuple(r) for r in last.collect()), key=str) == sorted((tuple(r) for r in want.collect()), key=str)


def test_quota(spark, sf, tmp_path):
    e = events(spark, sf).select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    out = run(sessions.quota_stream(files(spark, e, str(tmp_path)), 3, 3_600_000), "w2", "append")
    got = out.groupBy("user_id").agg(F.sum(F.col("allowed").cast("long")), F.sum((~F.col("allowed")).cast("long")), F.max("session_no"))
    want = quota.quota_fold(e, "user_id", "ms", "event_id", 3, 3_600_000).select("user_id", "asked", "blocked", "sessions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_session_windows_of_closed_sessions(spark, sf, tmp_path):
    e = events(spark, sf)
    stream = sessions.session_windows(files(spark, e, str(tmp_path)), gap="1 hour", late="1 hour")
    got = {tuple(r) for r in run(stream, "w3", "append").collect()}
    want = {tuple(r) for r in sessions.session_windows(e, gap="1 hour").collect()}
    edge = max(r[2] for r in want)
    from datetime import timedelta

    closed = {r for r in want if r[2] < edge - timedelta(hours=3)}
    assert closed and closed <= got <= want
