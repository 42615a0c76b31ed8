"""Shared helpers: the shared folder, written intermediate tables, word columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
WS = " \t\n\x0b\x0c\r"
#: A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share (spark.checkpoint.dir).

    Where a local session names none, as in tests, a temporary folder is made
    once and set as the checkpoint folder; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clean() -> int:
    """Remove what this process wrote into the shared folder; returns the number of paths.

    Results are lazy and read these tables, so call it when all results are stored.
    """
    done = 0
    while _MADE:
        path = _MADE.pop()
        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)
            done += 1
    return done


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds within the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without running
    the earlier stages again, and every later use sees the same rows. Nothing
    can need the job's shuffle files again, so Spark removes them at its end.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null or blank texts."""
    bare = F.btrim(text, F.lit(WS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, col: str) -> int:
    """Bytes of a text column over the whole table."""
    return df.agg(F.coalesce(F.sum(F.octet_length(col).cast("long")), F.lit(0))).first()[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
