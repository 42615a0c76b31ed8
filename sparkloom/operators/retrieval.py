"""Retrieval: corpora, cosine search, threshold, sources and prompt context.

A search is one scan of each corpus (only id, title, description and vector),
a union and a top-k: a TakeOrderedAndProject, so each task sends k rows. With
several questions, rows and questions are packed into blocks of bounded size,
which are shuffled once; a task reads blocks of rows beside one block of
questions, scores them by products of matrices and keeps k rows a question.
Titles and descriptions join the hits at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sparkloom.functions import text as T
from sparkloom.functions import vector as V
from sparkloom.functions.memory import lean
from sparkloom.operators import merge
from sparkloom.operators.tiles import first as best_hits
from sparkloom.operators.tiles import nearest, packed, usable
from sparkloom.session import SETTINGS

#: Fixed value: the answer where nothing relevant was found.
APOLOGY = "Désolé, je n'ai pas trouvé d'information pertinente dans mon CV pour répondre à cette question."
#: The columns every corpus has, in the order of the union.
CORPUS = ("type", "id", "child_id", "title", "description", "embedding")


def corpus(df: DataFrame, kind: str, item_id: Column, title: Column, description: Column, child_id: Column | None = None, embedding: str = "embedding") -> DataFrame:
    """Tagged rows of one corpus; rows without a vector are left out."""
    child = F.lit(None) if child_id is None else child_id
    return df.where(F.col(embedding).isNotNull()).select(F.lit(kind).alias("type"), item_id.cast("bigint").alias("id"), child.cast("bigint").alias("child_id"), title.alias("title"), description.alias("description"), F.col(embedding).alias("embedding"))


def profile_corpora(experiences: DataFrame, projects: DataFrame, formations: DataFrame, informations: DataFrame, with_projects: bool = False) -> DataFrame:
    """The searched corpora. An experience appears once for each
    of its projects (and once without any), with the same id, title and score.
    Descriptions and titles keep the null of any part. Projects are searched on
    request only."""
    told = ("objective", "problem", "solution", "results", "impact", "description")
    p = projects.select("experience_id", F.col("id").alias("project_id"), *[F.col(k).alias(f"p_{k}") for k in told])
    e = experiences.select("id", "role", "start_date", "end_date", "context", "embedding").join(p, F.col("id") == F.col("experience_id"), "left")
    c, span = F.col, [T.date_text(F.col("start_date")), " à ", T.date_text(F.col("end_date"))]
    # The words between the fields.
    story = [x for k in told for x in (" ", c(f"p_{k}"))]
    person = ["je suis ", c("prenom"), " ", c("nom"), " avec le prenom prononcé ", c("prononciation"), " né à ", c("pays_naissance"), " le ", T.date_text(c("date_naissance"))]
    passion = ["Passioné depuis par les sciences dures et les nouvelles technologies, aussi je suis ", c("passion")]
    parts = [
        corpus(e, "experience", c("id"), c("role"), T.concat_strict(*span, " description : ", c("context"), *story), c("project_id")),
        corpus(formations, "formation", c("id"), c("degree"), T.concat_strict(*span, " description ", c("description"))),
        corpus(informations, "information", c("id"), T.concat_strict(*person), T.concat_strict(*passion)),
    ]
    if with_projects:
        parts.append(corpus(projects, "project", c("id"), c("name"), c("description")))
    return reduce(DataFrame.union, parts)


def search(corpora: DataFrame, query: list[float], k: int = SETTINGS.top_k) -> DataFrame:
    """The k best rows for one vector, with score. Ties go by type, id and child."""
    q = V.literal(query)
    qn = sum(float(x) * float(x) for x in query) ** 0.5
    s = corpora.where(F.col("embedding").isNotNull()).withColumn("score", V.cosine(V.dot(F.col("embedding"), q), V.norm(F.col("embedding")) * F.lit(qn)))
    return s.drop("embedding").orderBy(F.col("score").desc_nulls_last(), "type", "id", F.col("child_id").asc_nulls_first()).limit(k)


#: Numbers (rows times dimensions) of a block of rows, and questions of a block at most.
TILE_NUMBERS, TILE_QUESTIONS = 1 << 20, 8192
#: Tasks a core among which pairs of blocks are dealt, and questions of a block at least for their sake.
_WAVES, _FEW = 4, 1024
#: Hits of a group, where those of all parts of the rows meet.
_HITS = 1 << 19
#: Lengths between these have squares and products that neither vanish nor overflow.
_SHORT, _LONG = 1e-140, 1e140


def _kind(vec: str, dim: int) -> Column:
    """0: a vector for the tiles; 1: one of length zero, which scores NaN; 2: any other, which only the plain expression scores."""
    n = V.norm(F.col(vec))
    return F.when(~usable(F.col(vec), dim), 2).when(n == 0, 1).when((n > _SHORT) & (n < _LONG), 0).otherwise(2)


def _packed(df: DataFrame, n: int, number: str, vec: str, kind: str, *cols: str) -> DataFrame:
    """df in n blocks of a row each: block, cols as arrays, the block's vectors as bytes."""
    out = S.StructType([S.StructField("block", S.IntegerType()), *[S.StructField(c, S.ArrayType(df.schema[c].dataType)) for c in cols], S.StructField("vector", S.BinaryType())])
    blocks = df.select(F.pmod(number, F.lit(n)).cast("int").alias("block"), *cols, F.col(vec).cast(f"array<{kind}>").alias("vector"))
    return blocks.groupBy("block").applyInArrow(lean(packed), out)


def _tiles(rows: DataFrame, asked: DataFrame, n_rows: int, n_asked: int, dim: int, k: int) -> DataFrame:
    """_qid, _row, _at and score: the k best rows of each question.

    Rows and questions are shuffled once, into blocks; a task reads every block
    of its part of the rows beside one block of questions, and keeps k rows a
    question. There are so few parts (one, where blocks of questions keep all
    cores busy) that hits, too, grow with the questions alone.
    """
    spark, kind = rows.sparkSession, "float" if rows.schema["embedding"].dataType == asked.schema["_q"].dataType == S.ArrayType(S.FloatType()) else "double"
    tasks, numbers = _WAVES * spark.sparkContext.defaultParallelism, max(1, TILE_NUMBERS // dim)
    i, j = max(1, -(-n_rows // numbers)), max(1, -(-n_asked // min(TILE_QUESTIONS, numbers, max(_FEW, -(-n_asked // tasks)))))
    parts = min(i, -(-tasks // j))
    left = _packed(rows, i, "_row", "embedding", kind, "_row", "_at").repartitionById(parts, F.pmod("block", F.lit(parts)))
    right = _packed(asked, j, "_no", "_q", kind, "_no", "_qid").repartitionById(j, F.col("block")).withColumnsRenamed({"block": "q_block", "vector": "q_vector"})
    hit = S.StructType([S.StructField("_no", S.LongType()), S.StructField("_qid", asked.schema["_qid"].dataType), *[S.StructField(c, S.LongType()) for c in ("_row", "_at")], S.StructField("score", S.DoubleType())])
    # a row of this join is a pair of blocks
    pairs = left.drop("block").hint("shuffle_replicate_nl").crossJoin(right)
    hits = merge.stored(pairs.mapInArrow(lambda batches: nearest(batches, k, dim, kind), hit))
    groups = max(1, -(-n_asked * min(k * parts, n_rows) // _HITS))
    return hits.groupBy(F.pmod("_no", F.lit(groups))).applyInArrow(lean(lambda t: best_hits(t, k)), S.StructType(hit.fields[1:]))


def ranked(corpora: DataFrame, questions: DataFrame, k: int = SETTINGS.top_k, qid: str = "query_id", vec: str = "query_embedding", broadcast_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The k best rows for each of many questions (qid, vec), as qid, _at, score and rank; and the corpora, with the _at of each row.

    Corpora and questions are stored first, and the corpora's vectors in the
    order of ties. Vectors of finite numbers, as many as most questions have,
    meet in tiles. Of those of length zero, which score NaN with all, the first
    k rows serve every question. Any others are scored by the plain expression,
    with questions in blocks of broadcast_rows, so that what is broadcast has a
    bound.
    """
    q = questions.where(F.col(vec).isNotNull()).select(F.col(qid).alias("_qid"), F.col(vec).alias("_q"))
    q = merge.stored(q.withColumns({"_n": F.size("_q"), "_no": F.monotonically_increasing_id()}))
    most = q.groupBy("_n").count().orderBy(F.desc("count"), "_n").first()
    dim = max(1, most["_n"]) if most else 1
    q = q.select("_no", "_qid", "_q", _kind("_q", dim).alias("_kind"))
    whole = merge.stored(corpora.where(F.col("embedding").isNotNull()).select(*CORPUS, F.monotonically_increasing_id().alias("_at"), _kind("embedding", dim).alias("_kind")))
    # _row: a row's place in the order of ties
    ties = whole.drop("title", "description").orderBy("type", "id", F.col("child_id").asc_nulls_first(), "_at")
    c = merge.stored(ties.select(F.monotonically_increasing_id().alias("_row"), "_at", "embedding", "_kind"))
    rows_of, asked_of = ({r["_kind"]: r["count"] for r in t.groupBy("_kind").count().collect()} for t in (c, q))
    keys, by = ["_row", "_at"], [F.col("score").desc_nulls_last(), F.col("_row")]
    top = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("_qid").orderBy(*by))).where(F.col("rank") <= k)
    of = lambda t, *kinds: t.where(F.col("_kind").isin(*kinds))
    first = lambda t: F.broadcast(t.select(*keys).orderBy("_row").limit(k))
    nan = F.lit(float("nan")).alias("score")

    def plain(rows: DataFrame, asked: DataFrame, n: int) -> DataFrame:
        rows, asked = rows.withColumn("_cn", V.norm(F.col("embedding"))), asked.withColumn("_qn", V.norm(F.col("_q")))
        blocks = 1 if n <= broadcast_rows else -(-2 * n // broadcast_rows)  # half full on average, so none is over the bound
        score = V.cosine(V.dot(F.col("embedding"), F.col("_q")), F.col("_cn") * F.col("_qn")).alias("score")
        parts = (top(rows.crossJoin(F.broadcast(asked.where(F.pmod(F.xxhash64("_qid", "_q"), F.lit(blocks)) == b))).select("_qid", *keys, score)).drop("rank") for b in range(blocks))
        return merge.gathered(q.sparkSession, parts)

    found = _tiles(of(c, 0), of(q, 0), rows_of.get(0, 0), asked_of.get(0, 0), dim, k)
    if rows_of.get(1):
        found = found.unionByName(of(q, 0).select("_qid").crossJoin(first(of(c, 1))).select("_qid", *keys, nan))
    if asked_of.get(1):
        found = found.unionByName(of(q, 1).select("_qid").crossJoin(first(of(c, 0, 1))).select("_qid", *keys, nan))
    if rows_of.get(2):
        found = found.unionByName(plain(of(c, 2), q, sum(asked_of.values())))
    if asked_of.get(2):
        found = found.unionByName(plain(of(c, 0, 1), of(q, 2), asked_of[2]))
    return top(found).select(F.col("_qid").alias(qid), "_at", "score", "rank"), whole


def told(best: DataFrame, rows: DataFrame, qid: str = "query_id") -> DataFrame:
    """What ranked gives, with the rows themselves."""
    return best.join(rows, "_at").select(qid, *[c for c in CORPUS if c != "embedding"], "score", "rank")


def search_many(corpora: DataFrame, questions: DataFrame, k: int = SETTINGS.top_k, qid: str = "query_id", vec: str = "query_embedding", broadcast_rows: int = 10_000) -> DataFrame:
    """The k best rows for each of many questions: qid, type, id, child_id, title, description, score, rank."""
    return told(*ranked(corpora, questions, k, qid, vec, broadcast_rows), qid)


def relevant(hits: DataFrame, threshold: float = SETTINGS.threshold) -> DataFrame:
    """P5: after the top-k (a NaN row has used a slot), inclusive, never NaN."""
    return hits.where(V.passes(F.col("score"), threshold))


def sources(hits: DataFrame, n: int = SETTINGS.sources_shown) -> DataFrame:
    """The first n hits as shown."""
    top = hits.orderBy(F.col("score").desc_nulls_last(), "type", "id", F.col("child_id").asc_nulls_first()).limit(n)
    return top.select("type", "title", "score", "id", T.percent(F.col("score")).alias("percent"), T.deep_link(F.col("type"), F.col("id")).alias("link"))


def chunk_text(chars: int = SETTINGS.context_chars) -> Column:
    """one chunk of the prompt, its title on a line of its own; a null title or description is an empty one."""
    return F.concat(F.lit("["), F.upper("type"), F.lit("] "), F.coalesce(F.col("title"), F.lit("")), F.lit("\n"), T.prefix(F.coalesce(F.col("description"), F.lit("")), chars))


def prompt_context(hits: DataFrame, by: list[str] | None = None, chars: int = SETTINGS.context_chars) -> DataFrame:
    """The chunks in order of score as one text (of each group of `by`)."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "type", "id", F.coalesce("child_id", F.lit(-1)).alias("child_id"), chunk_text(chars).alias("t"))))
    return hits.groupBy(*(by or [])).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("context"), F.count("*").alias("n_chunks"))


def log_chunks(hits: DataFrame, by: list[str]) -> DataFrame:
    """Chunks as an array of (id, type, score), best first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "type", "id", "score")))
    return hits.groupBy(*by).agg(F.transform(ordered, lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["score"].alias("score"))).alias("retrieved_chunks"), F.count("*").alias("nb_chunks_retrieved"))


def unanswered(questions: DataFrame, hits: DataFrame, qid: str = "query_id", apology: str = APOLOGY) -> DataFrame:
    """Questions without a surviving chunk: fixed answer, provider none, no cost; never logged or counted."""
    left = questions.join(hits.select(qid).distinct(), qid, "left_anti")
    return left.withColumns({"response": F.lit(apology), "provider_used": F.lit("none"), "tokens_used": F.lit(0), "cost": F.lit(0.0)})
