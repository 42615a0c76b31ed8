"""The cache of vectors as a bucketed table.

Buckets are by hash; a lookup asks for one model, so the hash is what it joins on: it
shuffles the texts and not the cache. New vectors are appended; compaction rewrites the table with
one row a key. A table that is missing is an empty cache, and so are its files that are
missing or damaged: their texts are embedded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.operators import merge

KEYS = ["md5", "model"]


class VectorCache:
    def __init__(self, spark: SparkSession, name: str = "embeddings_cache", buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            return self.spark.createDataFrame([], schemas.EMBEDDINGS_CACHE)
        return self.spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").table(self.name)

    def append(self, rows: DataFrame) -> int:
        """Add the rows whose keys the cache does not have; returns their number."""
        new = rows.where(F.col("embedding").isNotNull()).select(*KEYS, "embedding").dropDuplicates(KEYS)
        new = merge.staged(new.join(self.read(), KEYS, "left_anti"))
        self._write(new, "append")
        return new.count()

    def compact(self) -> None:
        """One file a bucket and one row a key; the old files serve until the new ones are written."""
        self._write(merge.staged(self.read().dropDuplicates(KEYS)), "overwrite")

    def _write(self, rows: DataFrame, mode: str) -> None:
        if mode == "append" and rows.isEmpty() and self.spark.catalog.tableExists(self.name):
            return
        rows = merge.shaped(rows, schemas.EMBEDDINGS_CACHE).repartition(self.buckets, "md5")
        rows.write.mode(mode).format("parquet").bucketBy(self.buckets, "md5").sortBy("md5").saveAsTable(self.name)
