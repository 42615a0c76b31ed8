"""Session factory and settings."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Constants that are part of the semantics; each is a parameter of the operator that uses it."""

    top_k: int = 20
    threshold: float = 0.13
    context_chars: int = 500
    sources_shown: int = 3
    quota: int = 3
    cooldown_ms: int = 30
    embedding_price: float = 0.13  # per million tokens
    min_message: int = 1
    max_message: int = 1000
    timeout_s: float = 10.0  # of a provider

    @classmethod
    def from_env(cls, path: str | None = None, env: Mapping[str, str] = os.environ) -> Settings:
        """Values named like the fields (in any case), from a file of NAME=value lines and from the environment, which wins."""
        found: dict[str, str] = {}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                lines = (x.strip() for x in f)
                found |= dict((k.strip().lower(), v.strip().strip("'\"")) for k, _, v in (x.partition("=") for x in lines if "=" in x and not x.startswith("#")))
        found |= {k.lower(): v for k, v in env.items()}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kind(found[k]) for k, kind in kinds.items() if k in found})


SETTINGS = Settings()


def session(app: str = "sparkloom", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds within the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def alive(spark: SparkSession) -> bool:
    """Liveness probe."""
    return spark.sql("select 1").first()[0] == 1
