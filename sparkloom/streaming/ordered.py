"""W1, W2 as stateful processors: late turns wait, event-time timers release and expire them.

Turns may arrive in any order within the watermark. A turn waits in a list state until the
watermark has passed its time, so that nothing before it can still come; a timer then
releases all due turns in order, folds them and gives the rows. A second timer, `idle`
after a key's last turn, drops all its state. What a key holds is its turns of the
watermark's span and a few numbers.

Turns later than the watermark are left out by Spark; so is the memory of a session that
has been silent for longer than `idle`: a turn after that begins anew (its row says so by
its count). State needs the RocksDB provider (see configure).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sparkloom.operators import accounting
from sparkloom.operators import quota as Q
from sparkloom.session import SETTINGS

METRICS = "session_id long, question_count long, total_tokens long, total_cost decimal(10,6), avg_latency_ms long, providers_used map<string,bigint>"
DECISIONS = "user_id long, event_id long, ms long, allowed boolean, session_no long"


def configure(spark: SparkSession) -> None:
    """The state store that stateful processors need, unless the session names one."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Holds turns back until they are due. Subclasses name the columns of a turn (us and a tie first), their totals, and fold."""

    turn: str
    total: str
    zero: tuple

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.turn)
        self.totals = handle.getValueState("totals", f"last long, {self.total}")

    def fold(self, key: tuple, state: tuple, turns: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def drop(self) -> None:
        """Further state of a subclass."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [x.split()[0] for x in self.turn.split(", ")]
        first = None
        for df in rows:
            got = [tuple(None if pd.isna(x) else x for x in r) for r in df[names].astype(object).itertuples(index=False)]
            if got:
                self.waiting.appendList(got)
                first = min(r[0] for r in got) if first is None else min(first, *(r[0] for r in got))
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for r in self.waiting.get():
            (due if r[0] <= now else rest).append(tuple(r))
        if due:
            last, *state = tuple(self.totals.get()) if self.totals.exists() else (0, *self.zero)
            due.sort(key=lambda r: r[:2])
            state, out = self.fold(key, tuple(state), due)
            last = max(last, due[-1][0])
            self.totals.update((last, *state))
            if rest:
                self.waiting.put(rest)
                self._wake(min(r[0] for r in rest))
            else:
                self.waiting.clear()
                self.handle.registerTimer(-(-last // 1000) + self.idle_ms)
            return iter([out])
        if not rest and self.totals.exists() and now >= self.totals.get()[0] + self.idle_ms * 1000:
            self.totals.clear()
            self.drop()
        return iter(())

    def close(self) -> None:
        pass


class SessionMetrics(InOrder):
    """The session row after each release; providers are a map state, one entry each."""

    turn = "us long, event_id long, tokens long, latency long, cost double, provider string"
    total = "n long, tokens long, cost string, avg long"
    zero = (0, 0, "0", 0)

    def init(self, handle) -> None:
        super().init(handle)
        self.providers = handle.getMapState("providers", "provider string", "n long")

    def fold(self, key: tuple, state: tuple, turns: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        n, tokens, cost, avg = state
        cost = Decimal(cost)
        for _, _, t, latency, c, provider in turns:
            n, cost, avg = accounting.turn((n, cost, avg), latency, c)
            tokens += t or 0
            if provider is not None:
                now = self.providers.getValue((provider,))[0] if self.providers.containsKey((provider,)) else 0
                self.providers.updateValue((provider,), (now + 1,))
        used = {k[0]: v[0] for k, v in self.providers.iterator()}
        return (n, tokens, str(cost), avg), pd.DataFrame({"session_id": [key[0]], "question_count": [n], "total_tokens": [tokens], "total_cost": [cost], "avg_latency_ms": [avg], "providers_used": [used]})

    def drop(self) -> None:
        self.providers.clear()


class Quota(InOrder):
    """A decision for every question, in the order of their times."""

    turn = "us long, event_id long, ms long"
    total = "count long, at long, sessions long"
    zero = (0, -1, 0)

    def __init__(self, idle_ms: int, quota: int, cooldown_ms: int):
        super().__init__(idle_ms)
        self.quota, self.cooldown_ms = quota, cooldown_ms

    def fold(self, key: tuple, state: tuple, turns: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        count, at, sessions = state
        out = []
        for _, event, ms in turns:
            count, last, ok, fresh = Q.step(count, None if at < 0 else at, ms, self.quota, self.cooldown_ms)
            at = -1 if last is None else last
            sessions += fresh or sessions == 0
            out.append((key[0], event, ms, ok, sessions))
        return (count, at, sessions), pd.DataFrame(out, columns=["user_id", "event_id", "ms", "allowed", "session_no"])


def session_metrics(turns: DataFrame, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """turns (session_id, ts timestamp, event_id, tokens, latency, cost, provider) -> the running session row, update mode."""
    configure(turns.sparkSession)
    t = turns.select("session_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("event_id"), F.col("tokens").cast("long").alias("tokens"), F.col("latency").cast("long").alias("latency"), F.col("cost").cast("double").alias("cost"), "provider")
    return t.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(SessionMetrics(idle_ms), METRICS, "Update", "EventTime")


def quota(turns: DataFrame, late: str = "10 minutes", quota: int = SETTINGS.quota, cooldown_ms: int = SETTINGS.cooldown_ms, idle_ms: int = 86_400_000) -> DataFrame:
    """turns (user_id, ms, event_id) -> one decision a question. idle_ms is to be over cooldown_ms: then a key that was dropped is one whose quota is whole again."""
    if idle_ms < cooldown_ms:
        raise ValueError("state must outlive the cooldown")
    configure(turns.sparkSession)
    t = turns.select("user_id", F.timestamp_millis("ms").alias("ts"), (F.col("ms") * 1000).alias("us"), F.col("event_id").cast("long").alias("event_id"), "ms")
    return t.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Quota(idle_ms, quota, cooldown_ms), DECISIONS, "Append", "EventTime")
