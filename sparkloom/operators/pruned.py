"""Exact top-k search over clusters that bounds let whole questions skip.

Vectors are scaled to length 1 and assigned to the nearest of a bounded number of
centres; a cluster keeps the largest distance of a member from its centre. For a
question at distance d from a centre, no member scores better than
1 - max(0, d - radius)**2 / 2 (triangle inequality), so a cluster below the k-th best
score found so far cannot hold a hit. Each question first reads its nearest clusters,
enough for k rows; then only those whose bound reaches the k-th score it has. Nothing
is lost in any dimension: poor clusters cost time, never hits.

Rows lie sorted by cluster, so a scan for few clusters reads few row groups. Clusters
are cut into blocks and questions into groups of bounded size; a tile is one against the
other and returns k rows a question at most, so a cluster with a third of all rows is
the work of many tasks. Scores are summed in the order of the plain search, which makes
them and their ties the same to the last bit.

Defined cases: zero vectors score NaN, stand first and use slots, as in the plain search;
a zero question scores NaN with every row; vectors that are null, empty, of another length
or with null or non-finite components are not indexed, such questions have no hits; rows
that repeat are rows of their own; an empty corpus gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import merge, retrieval
from sparkloom.operators.tiles import SLACK, usable
from sparkloom.operators.tiles import best as _best
from sparkloom.operators.tiles import matrix as _matrix
from sparkloom.session import SETTINGS

ROWS = "cluster int, batch long, row long, distance double, type string, id long, child_id long, title string, description string, embedding array<double>"
ZERO = -1  # the cluster of vectors without a direction


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres_of(sample: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centres of unit vectors, from rows spread over the sample."""
    c = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, c)[0]
        total, count = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, sample)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def nearest(u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance from the differences themselves."""
    near = np.concatenate([((c * c).sum(axis=1) - 2 * u[i : i + 2000] @ c.T).argmin(axis=1) for i in range(0, len(u), 2000)] or [np.zeros(0, int)])
    return near, np.sqrt(((u - c[near]) ** 2).sum(axis=1))


@dataclass
class Clusters:
    """path holds the rows; centres (clusters by dim), radius and count describe them and are bounded by the number of clusters."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/rows")


def build(corpora: DataFrame, path: str, clusters: int | None = None, sample_rows: int = 20_000, most: int = 4096) -> Clusters:
    """Index the corpora (columns of retrieval.CORPUS) below path.

    Centres are fitted on a sample of sample_rows vectors (those of the least hash);
    clusters defaults to the square root of the number of rows, `most` at most.
    """
    spark = corpora.sparkSession
    first = corpora.where(F.size("embedding") > 0).select(F.size("embedding").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    dim = first["d"] if first else 1
    good = corpora.where(usable(F.col("embedding"), dim) & F.exists("embedding", lambda x: x != 0))
    drawn = good.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample_rows).collect()
    n = good.count() if len(drawn) == sample_rows else len(drawn)
    sample = np.array([r[0] for r in drawn], np.float64).reshape(-1, dim)
    c = centres_of(unit(sample), clusters or max(1, min(most, round(n**0.5)))) if n else np.zeros((1, dim))
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(c)], "cluster int, centre array<double>")
    table.coalesce(1).write.parquet(f"{path}/centres")
    insert(Clusters(spark, path, c, np.zeros(len(c)), np.zeros(len(c), np.int64)), corpora)
    return load(spark, path)


def insert(index: Clusters, corpora: DataFrame) -> None:
    """Add rows: the centres stay, radii and counts follow from what is appended. load() sees them."""
    c, dim = index.centres, index.dim
    stats = f"{index.path}/stats"
    batch = _batches(index.spark, stats)
    rows = corpora.where(usable(F.col("embedding"), dim)).select(F.lit(batch).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row"), "type", F.col("id").cast("long").alias("id"), F.col("child_id").cast("long").alias("child_id"), "title", "description", F.col("embedding").cast("array<double>").alias("embedding"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(b.schema.get_field_index("embedding")), dim)
            at, far = np.full(len(x), ZERO, np.int32), np.zeros(len(x))
            some = x.any(axis=1)
            near, d = nearest(unit(x[some]), c)
            at[some], far[some] = near, d
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), b.column(1), pa.array(far), *[b.column(k) for k in range(2, 8)]], names=["cluster", "batch", "row", "distance", *b.schema.names[2:]])

    placed = merge.staged(rows.mapInArrow(assign, ROWS))
    placed.repartitionByRange("cluster", "row").sortWithinPartitions("cluster", "row").write.mode("append").parquet(f"{index.path}/rows")
    placed.groupBy("cluster").agg(F.max("distance").alias("radius"), F.count("*").alias("n"), F.max("batch").alias("batch")).coalesce(1).write.mode("append").parquet(stats)


def _batches(spark: SparkSession, stats: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stats)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return 0
    return (spark.read.schema("batch long").parquet(stats).agg(F.max("batch")).first()[0] or 0) + 1


def load(spark: SparkSession, path: str) -> Clusters:
    """An index as it lies below path; the driver reads a row a cluster."""
    centres = {r["cluster"]: r["centre"] for r in spark.read.schema("cluster int, centre array<double>").parquet(f"{path}/centres").collect()}
    c = np.array([centres[k] for k in range(len(centres))], np.float64)
    radius, count = np.zeros(len(c)), np.zeros(len(c), np.int64)
    stats = spark.read.schema("cluster int, radius double, n long").parquet(f"{path}/stats").groupBy("cluster").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
    for r in stats.where(F.col("cluster") >= 0).collect():
        radius[r["cluster"]], count[r["cluster"]] = r["radius"], r["n"]
    return Clusters(spark, path, c, radius, count)


def _question_schema(questions: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("qid", questions.schema["qid"].dataType), T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("clusters", T.ArrayType(T.IntegerType()))])


def first_probes(index: Clusters, questions: DataFrame, k: int) -> DataFrame:
    """Each question's nearest clusters, enough for k rows."""
    c, count, dim = index.centres, index.count, index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = unit(_matrix(b.column(1), dim))
            order = np.argsort((c * c).sum(axis=1) - 2 * q @ c.T, axis=1, kind="stable")
            need = (np.cumsum(count[order], axis=1) < k).sum(axis=1) + 1
            lists = [o[:n][count[o[:n]] > 0].tolist() for o, n in zip(order, need.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["qid", "q", "clusters"])

    return questions.select("qid", "q").mapInArrow(run, _question_schema(questions))


def last_probes(index: Clusters, questions: DataFrame) -> DataFrame:
    """questions: qid, q, seen (clusters read), least (k-th score so far, null where there are fewer). The other clusters whose bound reaches it."""
    c, radius, count, dim = index.centres, index.radius, index.count, index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = unit(_matrix(b.column(1), dim))
            d = np.sqrt(np.maximum((c * c).sum(axis=1) - 2 * q @ c.T + 1, 0))
            bound = 1 - np.maximum(0, d - radius - SLACK) ** 2 / 2
            lists = []
            for row, seen, least in zip(bound, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ok = (row >= (-2 if least is None else least) - SLACK) & (count > 0)
                ok[seen] = False
                lists.append(ok.nonzero()[0].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["qid", "q", "clusters"])

    return questions.select("qid", "q", "seen", "least").mapInArrow(run, _question_schema(questions))


def _hits(index: Clusters, probes: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Exact scores of the probed clusters: (qid, batch, row, type, id, child_id, score)."""
    spark = index.spark
    asked = merge.staged(probes.select("qid", F.col("q").alias("vector"), F.explode("clusters").alias("cluster")))
    # a row a cluster
    wanted = {r["cluster"]: r["count"] for r in asked.groupBy("cluster").count().collect()}
    size = [(c, -(-int(index.count[c]) // block_rows), -(-n // block_rows)) for c, n in sorted(wanted.items())]
    plan = F.broadcast(spark.createDataFrame(size, "cluster int, row_blocks int, question_blocks int"))
    rows = index.rows()
    if len(size) <= 1000:
        rows = rows.where(F.col("cluster").isin([c for c, _, _ in size]))
    of = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qid = probes.schema["qid"].dataType
    none = {"qid": qid, "batch": "long", "row": "long", "type": "string", "id": "long", "child_id": "long"}
    cols = ["cluster", "i", "j", "is_row", *none, "vector"]
    left = rows.join(plan, "cluster").withColumns({"i": of("row_blocks", "batch", "row"), "is_row": F.lit(True), "vector": F.col("embedding"), "qid": F.lit(None).cast(qid)}).withColumn("j", each("question_blocks"))
    right = asked.join(plan, "cluster").withColumns({"j": of("question_blocks", "qid"), "is_row": F.lit(False), **{c: F.lit(None).cast(t) for c, t in none.items() if c != "qid"}}).withColumn("i", each("row_blocks"))
    dim = index.dim
    schema = T.StructType([T.StructField("qid", qid), *[T.StructField(c, T.StringType() if c == "type" else T.LongType()) for c in ("batch", "row", "type", "id", "child_id")], T.StructField("score", T.DoubleType())])
    return left.select(*cols).unionByName(right.select(*cols)).groupBy("cluster", "i", "j").applyInArrow(lambda t: _best(t, k, dim), schema)


def search(index: Clusters, questions: DataFrame, k: int = SETTINGS.top_k, qid: str = "query_id", vec: str = "query_embedding", block_rows: int = 4096) -> DataFrame:
    """The k best rows of every question, as retrieval.search_many gives them: qid, type, id, child_id, title, description, score, rank."""
    q = questions.where(usable(F.col(vec), index.dim)).select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("q"))
    some = F.exists("q", lambda x: x != 0)
    by = [F.col("score").desc_nulls_last(), "type", "id", F.col("child_id").asc_nulls_first()]
    best = Window.partitionBy("qid").orderBy(*by, "batch", "row")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asked = merge.staged(first_probes(index, q.where(some), k))
    near = merge.staged(top(_hits(index, asked, k, block_rows)).drop("rank"))
    reached = near.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = last_probes(index, asked.join(reached, "qid", "left").select("qid", "q", F.col("clusters").alias("seen"), "least"))
    found = near.unionByName(_hits(index, rest, k, block_rows))
    # rows and questions without a direction score NaN with everything: the first k in order are the same for all
    keys = ["batch", "row", "type", "id", "child_id"]
    first = lambda df: F.broadcast(df.select(*keys).orderBy(*by[1:], "batch", "row").limit(k))
    nan = F.lit(float("nan")).alias("score")
    flat = first(index.rows().where(F.col("cluster") == ZERO))
    found = found.unionByName(q.where(some).select("qid").crossJoin(flat).select("qid", *keys, nan))
    found = found.unionByName(q.where(~some).select("qid").crossJoin(first(index.rows())).select("qid", *keys, nan))
    found = merge.staged(top(found))
    texts = index.rows().select("batch", "row", "title", "description")
    return found.join(texts, ["batch", "row"]).select(F.col("qid").alias(qid), *[c for c in retrieval.CORPUS if c != "embedding"], "score", "rank")
