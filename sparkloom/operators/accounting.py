"""Cost, query log, session metrics and transcripts."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sparkloom.functions import text as T
from sparkloom.operators.folds import ordered_fold


def with_cost(usage: DataFrame, prices: DataFrame, model: str = "model", tokens: str = "tokens", out: str = "cost") -> DataFrame:
    """Linear cost; a model without a price costs 0."""
    p = prices.select(F.col("model").alias("_m"), F.col("price").alias("_p"))
    return usage.join(p, F.col(model) == F.col("_m"), "left").withColumn(out, T.linear_cost(F.col(tokens), F.coalesce(F.col("_p"), F.lit(0.0)))).drop("_m", "_p")


def session_metrics(log: DataFrame, session: str, tokens: str, cost: str, latency: str) -> DataFrame:
    """A1, A2, A10: sums and means in the mathematical sense; order does not matter."""
    return log.groupBy(session).agg(F.count("*").alias("question_count"), F.sum(tokens).alias("total_tokens"), F.sum(cost).alias("total_cost"), F.floor(F.avg(latency)).cast("bigint").alias("avg_latency_ms"))


def session_metrics_exact(log: DataFrame, session: str, order: list[str], cost: str, latency: str) -> DataFrame:
    """A3, A4: the running fold, rounding at every step: the mean floors, the cost
    goes back to six decimals. `order` must be a total order within a session.

    Turns are sorted within partitions and folded batch by batch, so a session
    of any length needs the memory of one batch; its walk is one task's.
    """
    ansi = log.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    out = S.StructType([S.StructField("question_count", S.LongType()), S.StructField("total_cost", S.DecimalType(10, 6)), S.StructField("avg_latency_ms", S.LongType())])
    values = [F.col(latency).cast("bigint").alias("_l"), F.col(cost).cast("double").alias("_c")]
    return ordered_fold(log, session, order, values, (0, Decimal(0), 0), lambda state, lat, c: turn(state, lat, c, ansi), out)


def turn(state: tuple, lat: int | None, c: float | None, ansi: bool = True) -> tuple:
    """(questions, cost, mean latency) after one more turn."""
    n, total, avg = state
    avg = None if avg is None or lat is None else (avg * n + lat) // (n + 1)
    return n + 1, None if total is None or c is None else _six_decimals(float(total) + c, ansi), avg


def session_rows(log: DataFrame, session: str, order: list[str], tokens: str, cost: str, latency: str, provider: str) -> DataFrame:
    """K3, A1-A5: a session's row as its turns in order leave it: question_count,
    total_tokens, total_cost and avg_latency_ms (rounded at every step), and
    providers_used, the number of turns of each provider (there are few)."""
    ansi = log.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"

    def step(state: tuple, t: int | None, lat: int | None, c: float | None, p: str | None) -> tuple:
        n, total, money, avg, used = state
        n, money, avg = turn((n, money, avg), lat, c, ansi)
        used = used if p is None else {**used, p: used.get(p, 0) + 1}
        return n, total + (t or 0), money, avg, used

    names = ("question_count", "total_tokens", "total_cost", "avg_latency_ms", "providers_used")
    kinds = (S.LongType(), S.LongType(), S.DecimalType(10, 6), S.LongType(), S.MapType(S.StringType(), S.LongType()))
    values = [F.col(tokens).cast("bigint").alias("_t"), F.col(latency).cast("bigint").alias("_l"), F.col(cost).cast("double").alias("_c"), F.col(provider).cast("string").alias("_p")]
    out = S.StructType([S.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return ordered_fold(log, session, order, values, (0, 0, Decimal(0), 0, {}), step, out)


def json_text(value: Column) -> Column:
    """an array or map as JSON text, whatever quotes its values hold."""
    return F.to_json(value)


def _six_decimals(x: float, ansi: bool) -> Decimal | None:
    """Spark's cast of a double to decimal(10,6): half up on its shortest form; out of range, an error or null."""
    if math.isfinite(x) and abs(d := Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) < 10_000:
        return d
    if ansi:
        raise ArithmeticError(f"{x} is out of the range of decimal(10,6)")
    return None


def provider_counts(log: DataFrame, session: str, provider: str) -> DataFrame:
    """A5 in long form: session, provider, n."""
    return log.groupBy(session, provider).agg(F.count("*").alias("n"))


def provider_map(log: DataFrame, session: str, provider: str) -> DataFrame:
    """A5: one map a session (there are few providers)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(provider).alias("k"), F.col("n").alias("v"))))
    return provider_counts(log.where(F.col(provider).isNotNull()), session, provider).groupBy(session).agg(F.map_from_entries(entries).alias("providers_used"))


def question_count(sessions: DataFrame, asked: DataFrame, session: str = "session_id", count: str = "question_count") -> DataFrame:
    """A session's count; missing, null and 0 all read as 1."""
    c = sessions.groupBy(session).agg(F.max(count).alias("_c"))
    return asked.select(session).distinct().join(c, session, "left").select(session, F.coalesce(F.nullif(F.col("_c"), F.lit(0)), F.lit(1)).cast("bigint").alias("questions_count"))


def remaining(count: Column, quota: int = 3) -> Column:
    """Not clamped."""
    return F.lit(quota) - count


def query_log(turns: DataFrame, embedding_price: float) -> DataFrame:
    """K1, A10: the log row of a turn; turns carry tokens, costs and latencies in seconds."""
    ec = T.linear_cost(F.col("embedding_tokens"), embedding_price)
    ret, gen = T.milliseconds(F.col("retrieval_s")), T.milliseconds(F.col("generation_s"))
    dec = lambda c: c.cast("decimal(10,6)")
    return turns.select(
        "query_id", "session_id", "query_text", "retrieved_chunks", F.lit("vector").alias("retrieval_method"), (ret + gen).cast("int").alias("latency_ms"), "created_at",
        F.size("retrieved_chunks").alias("nb_chunks_retrieved"), F.col("provider_used").alias("llm_provider"), "embedding_tokens", F.col("tokens_used").alias("llm_tokens"),
        dec(ec).alias("embedding_cost"), dec(F.col("cost")).alias("llm_cost"), dec(ec + F.col("cost")).alias("total_cost"),
        ret.cast("int").alias("latency_retrieval_ms"), gen.cast("int").alias("latency_generation_ms"), (ret + gen).cast("int").alias("latency_total_ms"),
    )


def transcript(turns: DataFrame) -> DataFrame:
    """K2: a user row (no tokens) and an assistant row (all tokens) for each turn."""
    pair = F.array(F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("query_text").alias("content"), F.lit(0).alias("tokens_used")), F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.col("response").alias("content"), F.col("tokens_used").cast("int").alias("tokens_used")))
    return turns.select("query_id", "session_id", "created_at", F.explode(pair).alias("m")).select("query_id", "session_id", "m.seq", "m.role", "m.content", "m.tokens_used", "created_at")
