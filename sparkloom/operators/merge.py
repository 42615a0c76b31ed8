"""Writes without a table format: upserts, inserts, keys, replacement, constraints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import setting


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def earliest(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The first row of every key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """K4: last write wins; rows of `old` with a new version go. Idempotent."""
    last = latest(new, keys, order).select(*old.columns)
    return old.join(last.select(*keys), keys, "left_anti").select(*old.columns).unionByName(last)


def spread(df: DataFrame, keys: list[str], rows: int, task_rows: int = 1 << 20) -> DataFrame:
    """df dealt by its keys over as many tasks as `rows` need: what a task holds for them does not grow with the table."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))
    return df.repartition(n, *keys)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], task_rows: int = 1 << 20) -> DataFrame:
    """K5: rows whose key exists are left out, repeats among the new ones as well. A task takes about task_rows of the new rows."""
    fresh = spread(new, keys, new.count(), task_rows).dropDuplicates(keys)
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a temporary one where a local session names none)."""
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as compressed Parquet in the shared folder: a fraction of a checkpoint's bytes, and readers take the columns they need."""
    return gathered(df.sparkSession, [df])


def gathered(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts, stored part by part in the shared folder: the plan does not grow with their number.

    Nothing can need a part's shuffle files again, so Spark removes them at its end.
    """
    path, schema = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}", None
    for df in parts:
        with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("append").option("compression", "zstd").parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def surrogate_keys(df: DataFrame, order: list, out: str = "id", start: int = 1) -> DataFrame:
    """K6: consecutive ids in a total order, with one shuffle and no task that sees all rows.

    Rows are range-partitioned, sorted and staged with their place in their
    partition (the bounds are sampled, so a second run might draw others); the
    partitions' counts (one row each) give every partition its first id.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # monotonically_increasing_id: the partition's number above bit 33, the row's place in it below
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, total = [], start
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    first = spark.createDataFrame(before or [(0, start)], "_part long, _before long")
    return placed.join(F.broadcast(first), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def cascade(parents: DataFrame, children: DataFrame, deleted: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Delete parents by key, and the children that point to them."""
    gone = deleted.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone.withColumnRenamed(key, foreign), foreign, "left_anti").select(*children.columns)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness."""
    return df.groupBy(*keys).count().where("count > 1")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children without a parent (null references are allowed)."""
    return children.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def touch(df: DataFrame, col: str = "updated_at") -> DataFrame:
    """The update trigger: the time of the change."""
    return df.withColumn(col, F.current_timestamp().cast("timestamp_ntz"))


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap, so a failed write leaves the old one."""
    replace_tables({"": df}, path)


def replace_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables below one folder, all written beside it and swapped at once.

    Every rename is checked; where the new folder cannot take its place, the
    old one gets it back, and the old one goes last. Between the two renames
    the folder is absent, and one writer at a time is assumed.
    """
    spark = next(iter(tables.values())).sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{new}/{name}" if name else new)
    swap(hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop(path), hadoop(new), hadoop(old))


def swap(fs, path, new, old) -> None:
    """new takes the place of path; fs has exists, rename (false on failure) and delete."""

    def move(a, b) -> None:
        if not fs.rename(a, b):
            raise OSError(f"{a} could not be renamed to {b}")

    there = fs.exists(path)
    if there:
        move(path, old)
    try:
        move(new, path)
    except Exception:
        if there:
            move(old, path)
        raise
    if there:
        fs.delete(old, True)


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of ddl in their order and types; those that it lacks are null."""
    fields = T.StructType.fromDDL(ddl)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def append(df: DataFrame, path: str, ddl: str) -> None:
    """Append rows to the table at path, with its columns in their order; columns that df lacks are null."""
    shaped(df, ddl).write.mode("append").parquet(path)


def create_table(spark, name: str, ddl: str) -> None:
    """A table with an explicit schema (columns may have a DEFAULT)."""
    spark.sql(f"create table if not exists {name} ({ddl}) using parquet")


def add_columns(spark, name: str, ddl: str) -> None:
    """Further columns, with their defaults for the rows that are there; those that exist are left alone."""
    have = {c.lower() for c in spark.table(name).columns}
    new = [c.strip() for c in ddl.split(";") if c.strip().split()[0].lower() not in have]
    if new:
        spark.sql(f"alter table {name} add columns ({', '.join(new)})")


def applied(migrations: DataFrame, filename: str) -> bool:
    """Guard of a migration."""
    return not migrations.where(F.col("filename") == filename).isEmpty()
