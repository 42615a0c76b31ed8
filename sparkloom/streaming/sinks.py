"""K1, K2 as a streaming sink: several tables take a micro-batch together, exactly once.

Each table gets the batch as a folder of its own; then one marker, renamed into place, names
the batch as committed. Readers take committed batches only, so a batch is in all tables or
in none; a batch that is run again finds its marker and adds nothing, or, where it failed
before the marker, writes its folders anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.operators import accounting, merge


class Sink:
    """tables: name -> (rows of a batch for it, its columns as DDL). writer names the stream, as batch numbers are its own."""

    def __init__(self, path: str, tables: dict[str, tuple[Callable[[DataFrame], DataFrame], str]], writer: str = "stream"):
        self.path, self.tables, self.writer = path.rstrip("/"), tables, writer

    def __call__(self, batch: DataFrame, number: int) -> None:
        """For writeStream.foreachBatch."""
        spark = batch.sparkSession
        fs, marker = self._marker(spark, number)
        if fs.exists(marker):
            return
        held = batch.persist()
        try:
            for name, (rows, ddl) in self.tables.items():
                merge.shaped(rows(held), ddl).write.mode("overwrite").parquet(f"{self.path}/{name}/writer={self.writer}/batch={number}")
        finally:
            held.unpersist()
        # a whole file takes its name in one step; a hidden one is no marker
        hidden = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marker.getParent(), f"_{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray(b"committed"))
        out.close()
        if not fs.rename(hidden, marker):
            fs.delete(hidden, False)
            if not fs.exists(marker):
                raise OSError(f"batch {number} could not be committed")

    def _marker(self, spark: SparkSession, number: int):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/committed/{self.writer}-{number}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def committed(self, spark: SparkSession) -> DataFrame:
        """writer and batch of every marker; their names are read by tasks, from the listing."""
        none = spark.createDataFrame([], "writer string, batch long")
        fs, one = self._marker(spark, 0)
        if not fs.exists(one.getParent()):
            return none
        names = spark.read.format("binaryFile").load(f"{self.path}/committed").select(F.element_at(F.split("path", "/"), -1).alias("name"))
        return names.select(F.regexp_extract("name", r"^(.*)-\d+$", 1).alias("writer"), F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("batch"))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The committed rows of a table."""
        done, ddl = self.committed(spark), self.tables[name][1]
        if done.isEmpty():
            return spark.createDataFrame([], ddl)
        all_ = spark.read.schema(f"{ddl}, writer string, batch long").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return all_.join(done, ["writer", "batch"], "left_semi").drop("writer", "batch")


def turns_sink(path: str, embedding_price: float, writer: str = "stream") -> Sink:
    """The query log (K1) and the transcript (K2) of answered turns."""
    return Sink(path, {"retrieval_logs": (lambda t: accounting.query_log(t, embedding_price), schemas.RETRIEVAL_LOGS), "chat_messages": (accounting.transcript, f"{schemas.CHAT_MESSAGES}, query_id string, seq int")}, writer)
