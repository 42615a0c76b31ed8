"""Turns in any order within the watermark against the batch operators; sinks that commit once; session rows kept by buckets."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import accounting, incremental, quota
from sparkloom.streaming import ordered, sinks

BEGIN = datetime(2024, 3, 1)
TURNS = "session_id long, ts timestamp, event_id long, tokens long, latency long, cost double, provider string"


def turns(n=240, sessions=7, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice([0, 0, 0, *range(1, sessions)]), BEGIN + timedelta(seconds=20 * k + rnd.random()), k, rnd.randrange(900), rnd.randrange(4000), rnd.random() / 1e4, rnd.choice(["x", "y", None])) for k in range(n)]


def arrivals(rows, span=540, seed=2):
    """Rows in an order in which none is more than span seconds later than the latest before it."""
    rnd = random.Random(seed)
    return sorted(rows, key=lambda r: r[1] + timedelta(seconds=rnd.random() * span))


def stream(spark, rows, path, parts, schema=TURNS, end=timedelta(days=9)):
    """Files in order of arrival, one a micro-batch, and rows far ahead that move the watermark past all."""
    size = -(-len(rows) // parts)
    flush = [(-1, rows[0][1] + end * k, 10**9 + k, 0, 0, 0.0, None) for k in (1, 2)]
    for k, part in enumerate([*[rows[i * size : (i + 1) * size] for i in range(parts)], flush[:1], flush[1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k:03d}")
        for f in os.listdir(f"{path}/{k:03d}"):  # the source takes files by their time
            os.utime(f"{path}/{k:03d}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def run(df, name, mode, checkpoint):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
    q.processAllAvailable()
    held = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    q.stop()
    return df.sparkSession.table(name), held


def test_session_rows_from_shuffled_turns(spark, tmp_path):
    rows = turns()
    mixed = arrivals(rows)
    assert mixed != rows
    out, held = run(ordered.session_metrics(stream(spark, mixed, str(tmp_path / "in"), 6)), "o1", "update", str(tmp_path / "c"))
    last = out.where("session_id >= 0").groupBy("session_id").agg(F.max_by(F.struct("question_count", "total_tokens", "total_cost", "avg_latency_ms", "providers_used"), "question_count").alias("r")).select("session_id", "r.*")
    want = accounting.session_rows(spark.createDataFrame(rows, TURNS), "session_id", ["ts", "event_id"], "tokens", "cost", "latency", "provider")
    assert sorted(map(repr, last.collect())) == sorted(map(repr, want.collect()))
    # what is left is of the rows that moved the watermark
    print(held)
    assert max(held) >= 20 and held[-1] <= 8
    assert out.where("session_id >= 0").count() > last.count()  # rows came as turns were released, not only at the end


def test_quota_from_shuffled_turns(spark, tmp_path):
    rows = [(r[0], int(r[1].timestamp() * 1000), r[2]) for r in turns(seed=5)]
    schema = "user_id long, ms long, event_id long"
    mixed = [x for x, _ in arrivals([(r, datetime.fromtimestamp(r[1] / 1000)) for r in rows])]
    path = str(tmp_path / "in")
    flush = [(-1, rows[-1][1] + k * 10**9, 10**9 + k) for k in (1, 2)]
    for k, part in enumerate([mixed[:80], mixed[80:160], mixed[160:], flush[:1], flush[1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k}")
        for f in os.listdir(f"{path}/{k}"):
            os.utime(f"{path}/{k}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    out, held = run(ordered.quota(source, quota=3, cooldown_ms=90_000), "o2", "append", str(tmp_path / "c"))
    got = out.where("user_id >= 0").groupBy("user_id").agg(F.sum(F.col("allowed").cast("long")), F.sum((~F.col("allowed")).cast("long")), F.max("session_no"))
    want = quota.quota_fold(spark.createDataFrame(rows, schema), "user_id", "ms", "event_id", 3, 90_000).select("user_id", "asked", "blocked", "sessions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert held[-1] <= 8
    with pytest.raises(ValueError, match="outlive"):
        ordered.quota(source, cooldown_ms=10, idle_ms=5)


ANSWERED = "query_id string, session_id string, query_text string, response string, created_at timestamp, retrieved_chunks array<struct<id:bigint,type:string,score:double>>, retrieval_s double, generation_s double, provider_used string, embedding_tokens int, tokens_used int, cost double"


def answered(n):
    return [(f"q{k}", f"s{k % 3}", f"Why {k}?", f"So {k}.", BEGIN + timedelta(seconds=k), [(k, "v", 0.5)] * (k % 4), 0.25, 1.5, "p", 7, 40 + k, 0.001 * k) for k in range(n)]


def test_sink_commits_both_tables_once(spark, tmp_path):
    path, rows = str(tmp_path / "tables"), answered(30)
    sink = sinks.turns_sink(path, 0.13)
    parts = [spark.createDataFrame(rows[k : k + 10], ANSWERED) for k in (0, 10, 20)]
    assert sink.read(spark, "retrieval_logs").count() == 0
    for k, p in enumerate(parts):
        sink(p, k)
    for k, p in enumerate(parts):  # a restart runs batches again
        sink(p, k)
    whole = spark.createDataFrame(rows, ANSWERED)
    for name, (make, ddl) in sink.tables.items():
        want = sinks.merge.shaped(make(whole), ddl)
        assert sorted(map(repr, sink.read(spark, name).collect())) == sorted(map(repr, want.collect())), name
    assert sink.read(spark, "chat_messages").count() == 60


def test_sink_hides_half_a_batch(spark, tmp_path):
    good = sinks.turns_sink(str(tmp_path / "tables"), 0.13)
    bad = sinks.turns_sink(str(tmp_path / "tables"), 0.13)

    def fail(t):
        raise OSError("no space")

    bad.tables["chat_messages"] = (fail, bad.tables["chat_messages"][1])
    df = spark.createDataFrame(answered(5), ANSWERED)
    with pytest.raises(OSError, match="space"):
        bad(df, 0)
    assert good.read(spark, "retrieval_logs").count() == 0
    good(df, 0)
    assert good.read(spark, "retrieval_logs").count() == 5 and good.read(spark, "chat_messages").count() == 10


def test_sink_behind_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(answered(30)[10 * k : 10 * k + 10], ANSWERED).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(ANSWERED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    sink = sinks.turns_sink(str(tmp_path / "tables"), 0.13)
    for checkpoint in ("c", "c", "other"):  # going on, and from an empty checkpoint: the batches are those of the same writer
        q = source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / checkpoint)).start()
        q.processAllAvailable()
        q.stop()
    assert sink.read(spark, "retrieval_logs").count() == 30
    assert sink.committed(spark).count() == 3


def test_appends_renew_touched_buckets_only(spark, tmp_path):
    rows, path = turns(300, 40, 8), str(tmp_path / "k3")
    schema = TURNS.replace("ts timestamp", "ts timestamp_ntz")
    rnd = random.Random(0)
    rnd.shuffle(rows)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/sessions") for f in fs if f.endswith(".parquet")}
    before, last = {}, []
    for part in (rows[:200], rows[200:290], [r for r in rows[290:] if r[0]]):
        touched = incremental.append(spark.createDataFrame(part, schema), path, buckets=16)
        now = files()
        kept = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
        assert all(now[f] == before[f] for f in kept)
        before, last = now, touched
    assert len(last) < 16 and kept
    whole = spark.createDataFrame([*rows[:290], *[r for r in rows[290:] if r[0]]], schema)
    want = accounting.session_rows(whole, "session_id", ["ts", "event_id"], "tokens", "cost", "latency", "provider")
    assert sorted(map(repr, incremental.sessions(spark, path).collect())) == sorted(map(repr, want.collect()))
    assert incremental.append(spark.createDataFrame([], schema), path, buckets=16) == []
