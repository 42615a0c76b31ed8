"""The whole path of a question: validate, embed, retrieve, threshold, prompt, generate, account."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.models import Embedder, Generator, embed_texts, generate
from sparkloom.operators import accounting, incremental, merge, pruned, retrieval
from sparkloom.session import SETTINGS, Settings
from sparkloom.streaming import sinks

SYSTEM = "Tu es un assistant qui répond aux questions sur un parcours professionnel."
INSTRUCTIONS = "Réponds en français à partir du contexte seul, dans l'ordre chronologique, et dis-le clairement si la réponse n'y est pas."

#: Prompts (about) of a slice of the questions; what shuffles hold of prompts at once has this bound.
PROMPTS = 1 << 16


@dataclass
class Answers:
    """answered, log and sessions hold the turns that succeeded; failed those for
    which every provider failed, with their error; unanswered those without
    context; rejected the messages that are no valid question."""

    answered: DataFrame
    failed: DataFrame
    unanswered: DataFrame
    rejected: DataFrame
    log: DataFrame
    sessions: DataFrame


def user_prompt(context: Column, question: Column, instructions: str = INSTRUCTIONS) -> Column:
    """The context first, then the question, then what to heed."""
    return F.concat(F.lit("Contexte :\n"), context, F.lit("\n\nQuestion : "), question, F.lit(f"\n\n{instructions}"))


def answer(questions: DataFrame, corpora: DataFrame, prices: DataFrame, embedder: Embedder, providers: list[Generator], settings: Settings = SETTINGS, system: str = SYSTEM, instructions: str = INSTRUCTIONS, index: pruned.Clusters | None = None) -> Answers:
    """questions: session_id, query_text, created_at and query_id, if they have one (F19: else each gets a new one).

    Questions without a chunk above the threshold are answered with a fixed
    text; these, failed and rejected ones are neither logged nor counted (W5).
    Vectors, hits and answers are staged, so that no service is asked twice;
    prompts, the larger part by far, are not.
    A question's retrieval takes the time of its embedding call and its share
    of the search, which is one job for all. With an index of the corpora
    (pruned.build) the search reads it in their place, with the same hits.
    """
    own = F.col("query_id").cast("string") if "query_id" in questions.columns else F.lit(None).cast("string")
    questions = merge.staged(questions.withColumn("query_id", F.coalesce(own, T.new_id())))
    ok = questions.where(T.valid_message(F.col("query_text"), settings.min_message, settings.max_message))
    rejected = questions.where(~T.valid_message(F.col("query_text"), settings.min_message, settings.max_message))
    asked = merge.staged(embed_texts(ok, "query_text", embedder, "query_embedding", seconds="_embed_s"))
    n, began = asked.count(), time.perf_counter()
    # of a description no more than the prompt shows, before each of a question's hits carries it
    shown = T.prefix(F.col("description"), settings.context_chars)
    if index is None:
        best, rows = retrieval.ranked(corpora.withColumn("description", shown), asked, settings.top_k)
        # texts join the hits where they are used and are not stored with them
        hits = retrieval.told(merge.stored(retrieval.relevant(best, settings.threshold)), rows)
    else:
        hits = merge.stored(retrieval.relevant(pruned.search(index, asked, settings.top_k).withColumn("description", shown), settings.threshold))
    share = (time.perf_counter() - began) / max(n, 1)
    context = lambda found: retrieval.prompt_context(found, ["query_id"], settings.context_chars)
    timed = asked.select("query_id", "session_id", "query_text", "created_at", (F.col("_embed_s") + F.lit(share)).alias("retrieval_s"))
    prompted = lambda t: t.withColumn("system", F.lit(system)).withColumn("user", user_prompt(F.col("context"), F.col("query_text"), instructions))
    slices = max(1, -(-n // PROMPTS))

    def replies(b: int) -> DataFrame:
        mine = hits.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == b)
        prompts = prompted(timed.join(retrieval.log_chunks(mine, ["query_id"]).join(context(mine), "query_id"), "query_id"))
        return generate(prompts, "system", "user", providers, settings.timeout_s).drop("system", "user", "context")

    # answers are stored, prompts are not: who wants them puts them together from the hits again
    turns = merge.gathered(asked.sparkSession, map(replies, range(slices)))
    made = accounting.with_cost(turns.where(F.col("response").isNotNull()), prices, "provider_used", "tokens_used")
    made = made.withColumns({"embedding_tokens": T.word_count(F.col("query_text")), "generation_s": F.col("latency_ms") / 1000}).drop("latency_ms")
    whole = lambda t: prompted(t.join(context(hits).select("query_id", "context"), "query_id", "left"))
    log = accounting.query_log(made, settings.embedding_price)
    sessions = accounting.session_rows(log.withColumn("tokens", F.col("embedding_tokens") + F.col("llm_tokens")), "session_id", ["created_at", "query_id"], "tokens", "total_cost", "latency_total_ms", "llm_provider")
    return Answers(whole(made), whole(turns.where(F.col("response").isNull())), retrieval.unanswered(ok, hits), rejected, log, sessions)


def record(answers: Answers, folder: str, batch: int, settings: Settings = SETTINGS, writer: str = "batch", buckets: int = 64) -> None:
    """K1-K3: log and transcript of a run of answers, together and once (a batch number that is there adds nothing), then the rows of their sessions.

    Session rows are computed from the log, for the buckets of the sessions asked
    in only; those of other buckets keep their files. Running a batch again
    mends what failed between the two.
    """
    spark = answers.answered.sparkSession
    sink = sinks.turns_sink(folder, settings.embedding_price, writer)
    sink(answers.answered.drop("context", "system", "user"), batch)
    bucket = incremental.bucket("session_id", buckets)
    touched = [r["b"] for r in answers.answered.select(bucket.alias("b")).distinct().collect()]
    if not touched:
        return
    log = sink.read(spark, "retrieval_logs").where(bucket.isin(touched)).withColumn("tokens", F.col("embedding_tokens") + F.col("llm_tokens"))
    rows = accounting.session_rows(log, "session_id", ["created_at", "query_id"], "tokens", "total_cost", "latency_total_ms", "llm_provider")
    rows.withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/chat_sessions")
