"""Stateful streams: session metrics (W1), the quota machine (W2) and session windows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators import accounting
from sparkloom.operators import quota as Q
from sparkloom.session import SETTINGS

METRICS = "session_id long, question_count long, total_tokens long, total_cost decimal(10,6), avg_latency_ms long, providers_used map<string,bigint>"


def session_metrics_stream(turns: DataFrame) -> DataFrame:
    """Turns (session_id, ts, event_id, tokens, latency, cost, provider) -> the running session row, update mode.

    A micro-batch's turns are sorted before they are folded, so one batch and
    the batch operator agree; turns must not arrive later than their
    successors. A session's rows of one micro-batch are held together (bound
    them by the source's maxFilesPerTrigger or the like); its state is a few
    numbers, kept for good since a session never closes.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        n, tokens, avg, cost, used = tuple(state.get) if state.exists else (0, 0, 0, "0", "{}")
        money, used = Decimal(cost), json.loads(used)
        for t, lat, c, p in zip(rows["tokens"].tolist(), rows["latency"].tolist(), rows["cost"].tolist(), rows["provider"].tolist(), strict=True):
            n, money, avg = accounting.turn((n, money, avg), int(lat), c)
            tokens += int(t)
            if p is not None:
                used[p] = used.get(p, 0) + 1
        state.update((n, tokens, avg, str(money), json.dumps(used)))
        yield pd.DataFrame({"session_id": [key[0]], "question_count": [n], "total_tokens": [tokens], "total_cost": [money], "avg_latency_ms": [avg], "providers_used": [used]})

    return turns.groupBy("session_id").applyInPandasWithState(run, METRICS, "n long, tokens long, avg long, cost string, used string", "update", GroupStateTimeout.NoTimeout)


def quota_stream(turns: DataFrame, quota: int = SETTINGS.quota, cooldown_ms: int = SETTINGS.cooldown_ms) -> DataFrame:
    """Turns (user_id, ms, event_id) -> one decision a question."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"], kind="stable")
        count, last, sessions = tuple(state.get) if state.exists else (0, -1, 0)
        out = []
        for ms, event in zip(rows["ms"].tolist(), rows["event_id"].tolist(), strict=True):
            count, at, ok, fresh = Q.step(count, None if last < 0 else last, ms, quota, cooldown_ms)
            last = -1 if at is None else at
            sessions += fresh or sessions == 0
            out.append((key[0], event, ms, ok, sessions))
        state.update((count, last, sessions))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ms", "allowed", "session_no"])

    return turns.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, ms long, allowed boolean, session_no long", "count long, last long, sessions long", "append", GroupStateTimeout.NoTimeout)


def session_windows(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Session windows with a watermark; works on streams and on tables. A gap of exactly `gap` stays in the session's window."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_ts", late)
    w = e.groupBy(F.col(user), F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
