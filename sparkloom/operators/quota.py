"""The question quota (W2, W3): at most `quota` questions, then a cooldown that starts a new session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.folds import ordered_fold
from sparkloom.session import SETTINGS


def step(count: int, last_ms: int | None, now_ms: int, quota: int, cooldown_ms: int) -> tuple[int, int | None, bool, bool]:
    """One question: (count, last, allowed, new session). A gap equal to the cooldown already resets."""
    fresh = count >= quota and last_ms is not None and now_ms - last_ms >= cooldown_ms
    if fresh:
        count = 0
    if count >= quota:
        return count, last_ms, False, False
    return count + 1, now_ms, True, fresh


def remaining_ms(count: Column, last_ms: Column, now_ms: Column, quota: int = SETTINGS.quota, cooldown_ms: int = SETTINGS.cooldown_ms) -> Column:
    """Null under the quota, else what is left of the cooldown, 0 at least."""
    return F.when(count >= quota, F.greatest(F.lit(0).cast("bigint"), F.lit(cooldown_ms) - (now_ms - last_ms)))


def quota_fold(events: DataFrame, user: str, ms: str, tie: str, quota: int = SETTINGS.quota, cooldown_ms: int = SETTINGS.cooldown_ms) -> DataFrame:
    """Batch form: every user's questions in order -> asked, blocked and sessions."""

    def fold(state: tuple, t: int | None) -> tuple:
        asked, blocked, sessions, count, last = state
        count, at, ok, fresh = step(count, None if t is None else last, t, quota, cooldown_ms)
        return asked + ok, blocked + (not ok), sessions + (fresh or asked == 0), count, at if ok else last

    out = T.StructType([T.StructField(c, T.LongType()) for c in ("asked", "blocked", "sessions", "open_count", "last")])
    return ordered_fold(events, user, [ms, tie], [F.col(ms).cast("bigint")], (0, 0, 0, 0, None), fold, out).drop("last")
