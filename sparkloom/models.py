"""The model boundary: embedders and generators behind pandas functions.

The defaults are deterministic and offline: a hash-based embedder proves the
plumbing, not retrieval quality.
"""

from __future__ import annotations

import hashlib
import queue
import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import merge


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Generator(Protocol):
    name: str

    def generate(self, system: str, user: str) -> tuple[str, int]: ...


class HashEmbedder:
    """A fixed pseudo-random unit vector a text."""

    name = "hash"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little")).normal(size=self.dim)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


class TemplateGenerator:
    name = "template"

    def generate(self, system: str, user: str) -> tuple[str, int]:
        return f"Based on the context: {user.splitlines()[0] if user else ''}", len((system + " " + user).split())


class Unavailable(Exception):
    """What an embedder raises when its service fails; anything else is a bug and fails the job."""


def within(seconds: float, call: Callable, *args):
    """call(*args), or TimeoutError after so many seconds. The thread is a daemon: a service that hangs keeps no worker alive."""
    box: queue.Queue = queue.Queue(1)

    def run() -> None:
        try:
            box.put((call(*args), None))
        except BaseException as e:
            box.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    if error is not None:
        raise error
    return value


def embed_texts(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = 64, error: str | None = None, timeout_s: float = 30.0, seconds: str | None = None) -> DataFrame:
    """Vectors in batches inside tasks; a batch whose service fails
    or takes longer than timeout_s gives nulls, never zero vectors, and its error
    in the column `error` if named; `seconds`, if named, is the time of a row's
    batch. Stage the result: every use of it calls the embedder again."""

    @F.pandas_udf("v array<float>, e string, s double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got: list = []
            for k in range(0, len(s), batch):
                part = s.iloc[k : k + batch].fillna("").tolist()
                began = time.perf_counter()
                try:
                    rows = [(v, None) for v in within(timeout_s, embedder.embed, part)]
                except (Unavailable, OSError, TimeoutError) as e:
                    rows = [(None, f"{embedder.name}: {e}")] * len(part)
                got += [(*r, time.perf_counter() - began) for r in rows]
            yield pd.DataFrame(got, columns=["v", "e", "s"])

    made = df.withColumn("_made", run(F.col(text))).withColumn(out, F.col("_made.v"))
    more = {c: F.col(f"_made.{k}") for c, k in ((error, "e"), (seconds, "s")) if c}
    return made.withColumns(more).drop("_made") if more else made.drop("_made")


def embed_paced(
    df: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = 3, pause_s: float = 2.0, workers: int = 1, timeout_s: float = 30.0,
    retries: int = 3, backoff_s: float = 1.0, error: str | None = None, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Vectors of a service that is limited: `batch` texts in `pause_s` seconds over all, by `workers` calls at once.

    Each distinct text is asked for once, in as many tasks as there are workers;
    a task starts a call no sooner than pause_s * workers after its last one. A
    call that fails or exceeds timeout_s is tried again `retries` times, after
    backoff_s, twice that and so on; then its texts have no vector, and the
    error if a column is named for it. The vectors are staged before they meet
    the rows. A null text has none.
    """
    step = pause_s * workers

    @F.pandas_udf("v array<float>, e string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        last = None
        for s in batches:
            got: list = []
            for k in range(0, len(s), batch):
                part = s.iloc[k : k + batch].tolist()
                for attempt in range(retries + 1):
                    if last is not None and (wait := last + step - now()) > 0:
                        sleep(wait)
                    last = now()
                    try:
                        rows = [(v, None) for v in within(timeout_s, embedder.embed, part)]
                        break
                    except (Unavailable, OSError, TimeoutError) as e:
                        rows = [(None, f"{embedder.name}: {e}")] * len(part)
                        if attempt < retries:
                            sleep(backoff_s * 2**attempt)
                got += rows
            yield pd.DataFrame(got, columns=["v", "e"])

    texts = merge.staged(df.select(F.col(text).alias("_text")).where(F.col(text).isNotNull()).distinct().repartition(workers))
    made = merge.staged(texts.withColumn("_made", run(F.col("_text"))))
    made = made.select("_text", F.col("_made.v").alias(out), *([F.col("_made.e").alias(error)] if error else []))
    return df.join(made, F.col(text) == F.col("_text"), "left").drop("_text")


def cache_split(texts: DataFrame, cache: DataFrame, text: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, misses), by hash and model; each text once."""
    keyed = texts.select(F.col(text)).where(F.col(text).isNotNull()).distinct().withColumn("md5", F.md5(text)).withColumn("model", F.lit(model))
    known = cache.where(F.col("embedding").isNotNull()).select("md5", "model", "embedding")
    return keyed.join(known, ["md5", "model"]), keyed.join(known, ["md5", "model"], "left_anti")


def embed_cached(texts: DataFrame, cache: DataFrame, text: str, embedder: Embedder, embed: Callable[..., DataFrame] = embed_texts) -> tuple[DataFrame, DataFrame]:
    """(text with embedding, new cache rows). Failures are not cached; a
    second run embeds nothing. New vectors are staged, so each text is embedded
    once whatever uses them; `embed` is embed_texts or embed_paced."""
    hits, misses = cache_split(texts, cache, text, embedder.name)
    made = merge.staged(embed(misses, text, embedder))
    return hits.select(text, "embedding").unionByName(made.select(text, "embedding")), made.where("embedding is not null").select("md5", "model", "embedding")


def generate(df: DataFrame, system: str, user: str, providers: list[Generator], timeout_s: float = 10.0) -> DataFrame:
    """Providers in order, the first success wins.

    A provider with an empty `key` is left out; one that takes longer than
    timeout_s or raises has failed. Where all have, the answer is null and
    error tells why. latency_ms is that of the call that succeeded.
    """
    schema = "response string, tokens_used int, provider_used string, latency_ms int, error string"
    usable = [p for p in providers if not hasattr(p, "key") or p.key]

    @F.pandas_udf(schema)
    def run(systems: pd.Series, users: pd.Series) -> pd.DataFrame:
        rows = []
        for s, u in zip(systems.fillna(""), users.fillna(""), strict=True):
            errors = []
            for p in usable:
                began = time.perf_counter()
                try:
                    text, tokens = within(timeout_s, p.generate, s, u)
                    rows.append((text, tokens, p.name, int((time.perf_counter() - began) * 1000), None))
                    break
                except Exception as e:
                    errors.append(f"{p.name}: {e or type(e).__name__}")
            else:
                rows.append((None, None, None, None, "; ".join(errors) or "no provider with a key"))
        return pd.DataFrame(rows, columns=["response", "tokens_used", "provider_used", "latency_ms", "error"])

    return df.withColumn("_g", run(F.col(system), F.col(user))).select("*", "_g.*").drop("_g")
