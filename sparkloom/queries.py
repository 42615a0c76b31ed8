"""Registered queries over the driver's tables, each with SQL that gives the same rows.

Ids in the docstrings are those of the operator inventory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vector as V
from sparkloom.operators import accounting, incremental, merge, pruned, quota, retrieval, segments
from sparkloom.plans import answering
from sparkloom.sources import assets, ingest
from sparkloom.streaming import sessions, sinks

HOUR_MS = 3_600_000
PRICES = [("1-URGENT", 0.30), ("2-HIGH", 0.25), ("3-MEDIUM", 0.0)]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _query(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return _t(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _six(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def stand_in_profile(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The four profile tables over the driver's: customers with their orders (a fan-out), documents and nations."""
    e = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    c, o, d, n = (_t(spark, sf, x) for x in ("customer", "orders", "documents", "nation"))
    day = lambda key, unless=None: F.date_add(F.lit("2001-02-03").cast("date"), (F.col(key) % 1000).cast("int")) if unless is None else F.when(F.col(key) % unless != unless - 1, F.date_add(F.lit("2004-05-06").cast("date"), (F.col(key) % 1000).cast("int")))
    at = lambda t, key: t.join(e, F.col(key) == F.col("vec_id"))
    k = F.col
    return {
        "experiences": at(c, "c_custkey").select(k("c_custkey").alias("id"), k("c_name").alias("company"), k("c_mktsegment").alias("role"), day("c_custkey").alias("start_date"), day("c_custkey", 7).alias("end_date"), k("c_name").alias("context"), "embedding"),
        "projects": o.select(
            k("o_orderkey").alias("id"), k("o_custkey").alias("experience_id"), k("o_orderpriority").alias("name"), k("o_orderpriority").alias("objective"), k("o_orderstatus").alias("problem"), k("o_orderkey").cast("string").alias("solution"),
            F.when(k("o_orderkey") % 5 != 0, k("o_orderstatus")).alias("results"), k("o_orderpriority").alias("impact"), T.date_text(k("o_orderdate")).alias("description"), F.lit(None).cast("array<float>").alias("embedding"),
        ),
        "formations": at(d, "doc_id").select(k("doc_id").alias("id"), k("source").alias("degree"), day("doc_id").alias("start_date"), day("doc_id", 3).alias("end_date"), k("text").alias("description"), "embedding"),
        "informations": at(n, "n_nationkey").select(k("n_nationkey").alias("id"), k("n_name").alias("nom"), F.lower("n_name").alias("prenom"), k("n_name").alias("prononciation"), day("n_nationkey").alias("date_naissance"), k("n_name").alias("pays_naissance"), k("n_name").alias("passion"), "embedding"),
    }


def stand_in_corpora(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.profile_corpora(**stand_in_profile(spark, sf))


_COS = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])))"
_CLAMPED = f"greatest(-1.0, least(1.0, {_COS}))"
_DAY = "strftime(DATE '{from_}' + ({key} % 1000)::INT, '%Y-%m-%d')"
_BEGIN, _END = (lambda key: _DAY.format(from_="2001-02-03", key=key)), (lambda key, n: f"(CASE WHEN {key} % {n} <> {n - 1} THEN " + _DAY.format(from_="2004-05-06", key=key) + " END)")
_CORPORA = f"""
q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
corp AS (
  SELECT 'experience' AS type, c_custkey AS id, o_orderkey AS child_id, c_mktsegment AS title,
    {_BEGIN("c_custkey")} || ' à ' || {_END("c_custkey", 7)} || ' description : ' || c_name || ' ' || o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderkey || ' '
      || (CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END) || ' ' || o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS description, embedding
  FROM embeddings JOIN customer ON vec_id = c_custkey LEFT JOIN orders ON c_custkey = o_custkey
  UNION ALL
  SELECT 'formation', doc_id, NULL, source, {_BEGIN("doc_id")} || ' à ' || {_END("doc_id", 3)} || ' description ' || text, embedding
  FROM embeddings JOIN documents ON vec_id = doc_id
  UNION ALL
  SELECT 'information', n_nationkey, NULL,
    'je suis ' || lower(n_name) || ' ' || n_name || ' avec le prenom prononcé ' || n_name || ' né à ' || n_name || ' le ' || {_BEGIN("n_nationkey")},
    'Passioné depuis par les sciences dures et les nouvelles technologies, aussi je suis ' || n_name, embedding
  FROM embeddings JOIN nation ON vec_id = n_nationkey),
""" + """
hits AS (
  SELECT type, id, child_id, title, description, {cos} AS score FROM corp, q WHERE embedding IS NOT NULL
  ORDER BY score DESC NULLS LAST, type, id, child_id NULLS FIRST LIMIT 20),
kept AS (SELECT * FROM hits WHERE NOT isnan(score) AND score >= 0.13)
""".format(cos=_CLAMPED.format(a="embedding", b="qe"))

QUERIES: dict = {}
SQL: dict = {}


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.relevant(retrieval.search(stand_in_corpora(spark, sf), _query(spark, sf)))


@_register(f"WITH {_CORPORA} SELECT type, id, child_id, title, description FROM corp")
def profile_corpora(spark, sf):
    """All rows of the three corpora."""
    return stand_in_corpora(spark, sf).drop("embedding")


@_register(f"WITH {_CORPORA} SELECT type, id, child_id, title, description, round(score, 6) AS score FROM kept")
def context_search(spark, sf):
    """Flagship."""
    return _hits(spark, sf).select("type", "id", "child_id", "title", "description", _six("score"))


@_register(
    f"WITH {_CORPORA} SELECT type, title, round(score, 6) AS score, id, floor(score * 100 + 0.5)::BIGINT AS percent, '/cv#' || type || '-' || id AS link "
    "FROM (SELECT * FROM kept ORDER BY score DESC NULLS LAST, type, id, child_id NULLS FIRST LIMIT 3)"
)
def context_sources_top3(spark, sf):
    """O2 P9 F21 F24."""
    return retrieval.sources(_hits(spark, sf)).select("type", "title", _six("score"), "id", "percent", "link")


@_register(
    f"WITH {_CORPORA} SELECT string_agg('[' || upper(type) || '] ' || coalesce(title, '') || chr(10) || substring(coalesce(description, ''), 1, 500), chr(10) || chr(10) "
    "ORDER BY score DESC, type, id, coalesce(child_id, -1)) AS context, count(*) AS n_chunks FROM kept"
)
def prompt_context(spark, sf):
    """A9 F6 F7."""
    return retrieval.prompt_context(_hits(spark, sf))


def _plain_corpus(spark, sf):
    return retrieval.corpus(_t(spark, sf, "embeddings"), "v", F.col("vec_id"), F.lit(""), F.lit(""))


@_register(f"SELECT vec_id AS id, round({_CLAMPED.format(a='embedding', b='qe')}, 6) AS score FROM embeddings, (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0) ORDER BY {_CLAMPED.format(a='embedding', b='qe')} DESC, id LIMIT 20")
def vector_topk(spark, sf):
    """M1 M2 O1."""
    return retrieval.search(_plain_corpus(spark, sf), _query(spark, sf)).select("id", _six("score"))


@_register(
    f"SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_CLAMPED.format(a='e.embedding', b='q.embedding')} AS score, "
    f"row_number() OVER (PARTITION BY q.vec_id ORDER BY {_CLAMPED.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5"
)
def vector_topk_multi(spark, sf):
    """Questions are all vectors whose id is divisible by 100."""
    q = _t(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return retrieval.search_many(_plain_corpus(spark, sf), q, 5).select("query_id", "id", _six("score"), F.col("rank").cast("bigint"))


@_register(SQL["vector_topk_multi"])
def vector_topk_pruned(spark, sf):
    """The same over an index of clusters, most of which the bounds skip."""
    e = _t(spark, sf, "embeddings")
    c = retrieval.corpus(e, "v", F.col("vec_id"), F.lit(""), F.lit(""))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    index = pruned.build(c, f"{merge.shared_dir(spark)}/clusters-{uuid.uuid4().hex}")
    return pruned.search(index, q, 5).select("query_id", "id", _six("score"), F.col("rank").cast("bigint"))


@_register(
    "WITH v AS (SELECT vec_id AS id, embedding FROM embeddings UNION ALL SELECT -1, list_transform(embedding, lambda x: 0) FROM embeddings WHERE vec_id = 0 UNION ALL SELECT -2, NULL), "
    f"s AS (SELECT id, CASE WHEN list_inner_product(embedding, embedding) = 0 THEN 'NaN'::DOUBLE ELSE {_CLAMPED.format(a='embedding', b='qe')} END AS score "
    "FROM v, (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0) WHERE embedding IS NOT NULL), "
    "t AS (SELECT * FROM s ORDER BY score DESC NULLS LAST, id LIMIT 20) SELECT id, round(score, 6) AS score FROM t WHERE NOT isnan(score) AND score >= 0.13"
)
def vector_threshold_nan(spark, sf):
    """A zero vector scores NaN, uses a slot and is dropped; a null vector is not searched."""
    e = _t(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    zero = e.where("vec_id = 0").select(F.lit(-1).cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x * F.lit(0).cast("float")).alias("embedding"))
    none = zero.select(F.lit(-2).cast("bigint").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"))
    c = retrieval.corpus(e.union(zero).union(none), "v", F.col("vec_id"), F.lit(""), F.lit(""))
    return retrieval.relevant(retrieval.search(c, _query(spark, sf))).select("id", _six("score"))


@_register("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left_join_fanout(spark, sf):
    """J1."""
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")


@_register("SELECT c_custkey, o_orderkey, c_name || ' (' || strftime(o_orderdate, '%Y-%m-%d') || ')' AS description FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def null_propagating_description(spark, sf):
    """F1 F2 T5."""
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", T.concat_strict(F.col("c_name"), " (", T.date_text(F.col("o_orderdate")), ")").alias("description"))


@_register("SELECT p_partkey, array_to_string(list_filter(['Name: ' || nullif(p_name, ''), 'Brand: ' || CASE WHEN p_size > 10 THEN p_brand END, CASE WHEN p_size < 5 THEN '' ELSE p_type END], lambda x: x IS NOT NULL AND x <> ''), ' | ') AS text FROM part")
def text_template(spark, sf):
    """F3 F4 P8."""
    c = F.col
    parts = [T.labelled("Name", F.nullif(c("p_name"), F.lit(""))), T.labelled("Brand", F.when(c("p_size") > 10, c("p_brand"))), F.when(c("p_size") < 5, F.lit("")).otherwise(c("p_type"))]
    return _t(spark, sf, "part").select("p_partkey", T.join_parts(parts).alias("text"))


@_register("SELECT c_custkey, array_to_string(list(o_orderpriority ORDER BY o_orderkey), ', ') AS priorities FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def array_text(spark, sf):
    """F5."""
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    got = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("a"))
    return got.select("c_custkey", T.array_text(F.transform("a", lambda x: x["o_orderpriority"])).alias("priorities"))


@_register("SELECT doc_id, regexp_replace(nullif(text, ''), '[^\\x00-\\x7F]', '', 'g') AS ascii FROM documents")
def ascii_strip(spark, sf):
    """F10."""
    return _t(spark, sf, "documents").select("doc_id", T.ascii_only(F.col("text")).alias("ascii"))


@_register("SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS embedding_tokens, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 0.13 / 1e6, 12) AS embedding_cost FROM conversations WHERE role = 'user'")
def embedding_tokens(spark, sf):
    """F9 F16."""
    n = T.word_count(F.col("text")).cast("bigint")
    return _t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", n.alias("embedding_tokens"), F.round(T.linear_cost(n, 0.13), 12).alias("embedding_cost"))


@_register("SELECT md5, hit FROM (SELECT DISTINCT text, md5(text) AS md5, text IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) AS hit FROM documents WHERE text IS NOT NULL)")
def md5_cache_split(spark, sf):
    """F11 J6."""
    from sparkloom.models import cache_split

    d = _t(spark, sf, "documents")
    cache = d.where("doc_id % 2 = 0 and text is not null").select(F.md5("text").alias("md5"), F.lit("m").alias("model"), F.array(F.lit(1.0).cast("float")).alias("embedding")).distinct()
    hits, misses = cache_split(d, cache, "text", "m")
    return hits.select("md5", F.lit(True).alias("hit")).union(misses.select("md5", F.lit(False).alias("hit")))


@_register("SELECT o_orderkey, o_orderpriority, round(o_custkey * coalesce(price, 0.0) / 1e6, 9) AS cost FROM orders LEFT JOIN (VALUES ('1-URGENT', 0.30::DOUBLE), ('2-HIGH', 0.25), ('3-MEDIUM', 0.0)) p(model, price) ON o_orderpriority = model")
def cost_lookup_default(spark, sf):
    """J5 F16 T10."""
    prices = spark.createDataFrame(PRICES, "model string, price double")
    return accounting.with_cost(_t(spark, sf, "orders"), prices, "o_orderpriority", "o_custkey").select("o_orderkey", "o_orderpriority", F.round("cost", 9).alias("cost"))


@_register("SELECT k AS key, p_partkey, name FROM (SELECT p_partkey, trim(p_name) AS name, lower(trim(p_name)) AS k, row_number() OVER (PARTITION BY lower(trim(p_name)), p_brand ORDER BY p_partkey) AS rn FROM part WHERE trim(p_name) <> '') WHERE rn = 1")
def skill_dedup_first_wins(spark, sf):
    """A7 F12."""
    s = _t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.lit(None).cast("string").alias("proficiency_level"))
    return ingest.unique_skills([s], ["p_partkey"]).select("key", "p_partkey", "name")


@_register("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_last_wins(spark, sf):
    """K4: the first half loaded, the second upserted."""
    e = _t(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    mid = F.lit(e.agg(F.percentile_approx("event_id", 0.5)).first()[0])
    old = merge.latest(e.where(F.col("event_id") <= mid), ["user_id"], ["ts", "event_id"])
    both = merge.upsert(old, old.unionByName(e.where(F.col("event_id") > mid)), ["user_id"], ["ts", "event_id"])
    return both.select("user_id", "event_id", "event_type")


@_register("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def insert_ignore_bridge(spark, sf):
    """K5."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    keys = ["l_orderkey", "l_partkey"]
    old = merge.spread(li.where("l_orderkey % 2 = 0"), keys, li.count()).distinct()
    return merge.insert_ignore(old, li, keys)


@_register("SELECT id, l_orderkey, l_linenumber FROM lineitem JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders) ON o_orderkey = l_orderkey")
def surrogate_keys(spark, sf):
    """K6."""
    o = merge.surrogate_keys(_t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return _t(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("id", "l_orderkey", "l_linenumber")


_LOG = "SELECT user_id, ts, event_id, floor(abs(value) * 10)::BIGINT AS lat, abs(value) / 999983.0::DOUBLE AS cost FROM events WHERE value IS NOT NULL"


def _log(spark, sf):
    return _t(spark, sf, "events").where("value is not null").select("user_id", "ts", "event_id", "event_type", F.floor(F.abs("value") * 10).cast("bigint").alias("lat"), (F.abs("value") / 999983.0).alias("cost"))


@_register(
    f"WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ({_LOG})), "
    "f AS (SELECT user_id, 1::BIGINT AS n, lat AS avg, round(cost, 6)::DECIMAL(10,6) AS cost FROM l WHERE rn = 1 UNION ALL "
    "SELECT f.user_id, f.n + 1, (f.avg * f.n + l.lat) // (f.n + 1), (f.cost::DOUBLE + l.cost)::DECIMAL(10,6) FROM f JOIN l ON l.user_id = f.user_id AND l.rn = f.n + 1) "
    "SELECT user_id, n AS question_count, cost::DOUBLE AS total_cost, avg AS avg_latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM f) WHERE r = 1"
)
def session_metrics_exact_fold(spark, sf):
    """A3 A4."""
    return accounting.session_metrics_exact(_log(spark, sf), "user_id", ["ts", "event_id"], "cost", "lat").select("user_id", "question_count", F.col("total_cost").cast("double"), "avg_latency_ms")


@_register(f"SELECT user_id, count(*) AS question_count, sum(lat)::BIGINT AS total_tokens, round(sum(cost), 9) AS total_cost, floor(avg(lat))::BIGINT AS avg_latency_ms FROM ({_LOG}) GROUP BY user_id")
def session_metrics(spark, sf):
    """A1 A2."""
    m = accounting.session_metrics(_log(spark, sf), "user_id", "lat", "cost", "lat")
    return m.withColumn("total_cost", F.round("total_cost", 9))


@_register("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def session_provider_map(spark, sf):
    """A5 in long form."""
    return accounting.provider_counts(_t(spark, sf, "events"), "user_id", "event_type")


@_register(
    "WITH t AS (SELECT conv_id, turn, text, lead(role) OVER w AS nr, lead(text) OVER w AS answer, role FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    "p AS (SELECT conv_id, turn, text, answer FROM t WHERE role = 'user' AND nr = 'assistant') "
    "SELECT conv_id, turn, 0 AS seq, 'user' AS role, text AS content, 0 AS tokens_used FROM p UNION ALL SELECT conv_id, turn, 1, 'assistant', answer, length(answer)::INT FROM p"
)
def chat_transcript(spark, sf):
    """K2."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf, "conversations").where("role <> 'system'").withColumns({"nr": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    p = t.where("role = 'user' and nr = 'assistant'").select(F.col("turn").alias("query_id"), F.col("conv_id").alias("session_id"), F.col("text").alias("query_text"), F.col("answer").alias("response"), F.length("answer").alias("tokens_used"), F.lit(None).cast("timestamp").alias("created_at"))
    return accounting.transcript(p).select(F.col("session_id").alias("conv_id"), F.col("query_id").alias("turn"), "seq", "role", "content", "tokens_used")


@_register("SELECT conv_id, coalesce(nullif(count(*) FILTER (WHERE role = 'user'), 0), 1)::BIGINT AS questions_count, 3 - coalesce(nullif(count(*) FILTER (WHERE role = 'user'), 0), 1)::BIGINT AS questions_remaining FROM conversations GROUP BY conv_id")
def question_count_default(spark, sf):
    """S5 P11."""
    c = _t(spark, sf, "conversations")
    counted = c.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("question_count"))
    out = accounting.question_count(counted, c, "conv_id")
    return out.withColumn("questions_remaining", accounting.remaining(F.col("questions_count")))


@_register(
    f"SELECT vec_id AS query_id, '{retrieval.APOLOGY.replace("'", "''")}' AS response, 'none' AS provider_used, 0 AS tokens_used, 0.0::DOUBLE AS cost FROM embeddings q WHERE vec_id % 100 = 0 "
    f"AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id <> q.vec_id AND {_CLAMPED.format(a='e.embedding', b='q.embedding')} >= 0.9)"
)
def no_context_branch(spark, sf):
    """Questions are all vectors whose id is divisible by 100, each against all others."""
    e = _t(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    # of the two best at least one is another vector
    best = retrieval.search_many(retrieval.corpus(e, "v", F.col("vec_id"), F.lit(""), F.lit("")), q, 2).where("id <> query_id")
    return retrieval.unanswered(q, retrieval.relevant(best, 0.9)).drop("query_embedding")


@_register("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user') WHERE rn <= 3")
def quota_first3(spark, sf):
    """W2 without a reset."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf, "conversations").where("role = 'user'").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("conv_id", "turn")


@_register(
    "WITH RECURSIVE l AS (SELECT user_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events), "
    "f AS (SELECT user_id, rn, 1::BIGINT AS cnt, t AS last, 1::BIGINT AS asked, 0::BIGINT AS blocked, 1::BIGINT AS sessions FROM l WHERE rn = 1 UNION ALL "
    "SELECT f.user_id, l.rn, CASE WHEN f.cnt < 3 THEN f.cnt + 1 WHEN l.t - f.last >= 86400000::BIGINT THEN 1 ELSE f.cnt END, CASE WHEN f.cnt < 3 OR l.t - f.last >= 86400000::BIGINT THEN l.t ELSE f.last END, "
    "f.asked + (f.cnt < 3 OR l.t - f.last >= 86400000::BIGINT)::BIGINT, f.blocked + (NOT (f.cnt < 3 OR l.t - f.last >= 86400000::BIGINT))::BIGINT, f.sessions + (f.cnt >= 3 AND l.t - f.last >= 86400000::BIGINT)::BIGINT "
    "FROM f JOIN l ON l.user_id = f.user_id AND l.rn = f.rn + 1) "
    "SELECT user_id, asked, blocked, sessions, cnt AS open_count FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS r FROM f) WHERE r = 1"
)
def quota_cooldown_fold(spark, sf):
    """W2 with a cooldown of a day."""
    e = _t(spark, sf, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return quota.quota_fold(e, "user_id", "ms", "event_id", 3, 24 * HOUR_MS)


_HOT = "(SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_id, ts, value FROM events)"


def _hot(spark, sf):
    """Events of which one user has a third and more."""
    return _t(spark, sf, "events").withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))


@_register(SQL["quota_cooldown_fold"].replace("FROM events", f"FROM {_HOT}"))
def quota_hot_user(spark, sf):
    """W2 with a user whose questions are dealt over tasks."""
    e = _hot(spark, sf).select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return segments.quota_split(e, "user_id", "ms", "event_id", 3, 24 * HOUR_MS, hot_rows=1000, block_rows=512)


@_register(SQL["session_metrics_exact_fold"].replace("FROM events", f"FROM {_HOT}"))
def session_metrics_hot_user(spark, sf):
    """A3 A4 with a session whose turns are dealt over tasks."""
    e = _hot(spark, sf).where("value is not null").select("user_id", "ts", "event_id", F.floor(F.abs("value") * 10).cast("bigint").alias("lat"), (F.abs("value") / 999983.0).alias("cost"))
    m = segments.metrics_split(e, "user_id", ["ts", "event_id"], "cost", "lat", hot_rows=1000, block_rows=512)
    return m.select("user_id", "question_count", F.col("total_cost").cast("double"), "avg_latency_ms")


@_register(
    "WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 HOUR, TRUE) AS fresh, event_id FROM events), "
    "s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM l) "
    "SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000::BIGINT AS end_us, count(*) AS n FROM s GROUP BY user_id, g"
)
def events_session_window(spark, sf):
    """W extension: sessions with a gap of an hour."""
    w = sessions.session_windows(_t(spark, sf, "events"))
    return w.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@_register(f"SELECT vec_id, floor({_CLAMPED.format(a='embedding', b='qe')} * 100 + 0.5)::BIGINT AS percent FROM embeddings, (SELECT embedding AS qe FROM embeddings WHERE vec_id = 1)")
def score_percent_label(spark, sf):
    """F21 M1."""
    q = _query(spark, sf, 1)
    e = F.col("embedding")
    s = V.cosine(V.dot(e, V.literal(q)), V.norm(e) * F.lit(sum(x * x for x in q) ** 0.5))
    return _t(spark, sf, "embeddings").select("vec_id", T.percent(s).alias("percent"))


@_register("SELECT EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') AS applied, (SELECT count(*) FROM region) AS n")
def exists_and_count_guard(spark, sf):
    """S13 A6 in one pass."""
    return _t(spark, sf, "region").agg(F.coalesce(F.bool_or(F.col("r_name") == "ASIA"), F.lit(False)).alias("applied"), F.count("*").alias("n"))


@_register("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf):
    """S4 P7."""
    return _t(spark, sf, "orders").where("o_orderkey = 7")


@_register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark, sf):
    """Cascade of a delete."""
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return merge.cascade(c, o, c.where("c_mktsegment = 'BUILDING'"), "c_custkey", "o_custkey")[1].select("o_orderkey", "o_custkey")


@_register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def orphan_check(spark, sf):
    """Foreign-key check."""
    return merge.orphans(_t(spark, sf, "lineitem"), _t(spark, sf, "orders").where("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@_register("SELECT event_id, CASE WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE (m // 60) || 'h ' || (m % 60) || 'min' END AS duration, strftime(make_timestamp(event_id * 60000000), '%H:%M') AS clock, CASE WHEN m > 1 THEN 'restantes' ELSE 'restante' END AS label FROM (SELECT event_id, ceil(event_id * 61000 / 60000)::BIGINT AS m FROM events)")
def time_labels(spark, sf):
    """F22 F23 F25."""
    ms = F.col("event_id") * 61000
    return _t(spark, sf, "events").select("event_id", T.duration_text(ms).alias("duration"), T.clock(F.col("event_id") * 60000).alias("clock"), T.plural(F.ceil(ms / 60000), "restante").alias("label"))


@_register("SELECT conv_id, turn, length(text) BETWEEN 1 AND 1000 AND regexp_replace(text, '\\s', '', 'g') <> '' AS ok FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def message_validation(spark, sf):
    """P10."""
    return _t(spark, sf, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", T.valid_message(F.col("text")).alias("ok"))


@_register(None)
def answered_questions(spark, sf):
    """The whole path with the offline models."""
    from sparkloom.models import HashEmbedder, TemplateGenerator, embed_texts

    d = _t(spark, sf, "documents").select("doc_id", "source", "text")
    c = _t(spark, sf, "conversations").where("role = 'user'")
    q = c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("query_text"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    corpus = retrieval.corpus(embed_texts(d, "text", HashEmbedder()), "formation", F.col("doc_id"), F.col("source"), F.col("text"))
    prices = spark.createDataFrame([("template", 0.3)], "model string, price double")
    return answering.answer(q, corpus, prices, HashEmbedder(), [TemplateGenerator()]).log


@_register(
    "WITH q AS (SELECT conv_id, turn, text, 'Contexte :' || chr(10) || text AS u FROM conversations WHERE role = 'user') "
    "SELECT conv_id, turn, 'Based on the context: Contexte :' AS response, len(regexp_extract_all('be brief ' || u, '[^ \\t\\n\\x0b\\f\\r]+'))::INT AS tokens_used, 'template' AS provider_used FROM q"
)
def generated_answers(spark, sf):
    """The first provider has no key, the second is down, the third answers."""
    from sparkloom.models import TemplateGenerator, Unavailable, generate

    class Keyless(TemplateGenerator):
        name, key = "keyless", ""

    class Down(TemplateGenerator):
        name = "down"

        def generate(self, system: str, user: str) -> tuple[str, int]:
            raise Unavailable("down")

    c = _t(spark, sf, "conversations").where("role = 'user'")
    p = c.select("conv_id", "turn", F.lit("be brief").alias("system"), F.concat(F.lit("Contexte :\n"), "text").alias("user"))
    return generate(p, "system", "user", [Keyless(), Down(), TemplateGenerator()]).select("conv_id", "turn", "response", "tokens_used", "provider_used")


@_register(
    "WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS d FROM pages), n AS (SELECT page_id, octet_length(d) AS n FROM p) "
    "SELECT page_id, k::INT AS page_number, least(1000, n - 1000 * (k - 1))::INT AS width, 20 AS height FROM (SELECT page_id, n, unnest(range(1, (n + 999) // 1000 + 1)) AS k FROM n)"
)
def rendered_pages(spark, sf):
    """2.11: pages by a table function in SQL; here a page is 1000 bytes of a file."""
    assets.register_pages(spark, lambda data: [(data[k : k + 1000], len(data[k : k + 1000]), 20) for k in range(0, len(data), 1000)], "sparkloom_pages")
    _t(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("file_data")).createOrReplaceTempView("sparkloom_files")
    return spark.sql("select f.page_id, p.page_number, p.width, p.height from sparkloom_files f, lateral sparkloom_pages(f.file_data) p")


# ---- texts that are embedded, over stand-ins with nulls and empty values

_MAYBE = {"a": "CASE WHEN p_partkey % 3 <> 0 THEN p_name END", "b": "CASE WHEN p_partkey % 4 <> 0 THEN p_brand WHEN p_partkey % 8 = 0 THEN '' END", "c": "CASE WHEN p_partkey % 5 <> 0 THEN p_type END", "d": "CASE WHEN p_partkey % 7 <> 0 THEN 'd' || p_size END"}


def _parts(spark, sf, **cols: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", *[F.expr(_MAYBE[v]).alias(k) for k, v in cols.items()])


_OR = lambda x: f"coalesce({x}, '')"
_P = "(SELECT p_partkey, " + ", ".join(f"{v} AS {k}" for k, v in _MAYBE.items()) + " FROM part)"
_JOINED = lambda *parts: f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL AND x <> ''), ' | ')"


@_register(f"""SELECT p_partkey, {_JOINED("'Je suis ' || coalesce(a, '') || ' ' || coalesce(b, '') || ', avec mon prénom qui se prononce ' || coalesce(c, 'None') || ' '", "'Je suis née à ' || coalesce(d, 'None') || ' le ' || coalesce(a, 'None')", "'Je suis arrivé en ' || coalesce(b, 'None') || ' en 2015'", "'En plus de ma grande passion pour l''informatique, je suis également ' || coalesce(c, 'None')")} AS text FROM {_P}""")
def text_information(spark, sf):
    """F4."""
    return _parts(spark, sf, prenom="a", nom="b", prononciation="c", pays_naissance="d", date_naissance="a", location="b", passion="c").select("p_partkey", ingest.information_text().alias("text"))


@_register(
    f"""SELECT p_partkey, {_JOINED("'Date : ' || coalesce(a, '') || ' à ' || coalesce(b, '')", "'Entreprise : ' || coalesce(c, '') || ', ' || coalesce(d, 'None')", "'Rôle : ' || coalesce(a, '')", "'Type : ' || coalesce(b, '')", "c", "CASE WHEN p_partkey % 2 = 0 THEN a END", "CASE WHEN p_partkey % 2 = 0 THEN b END", "CASE WHEN p_partkey % 2 = 0 THEN c END", "CASE WHEN p_partkey % 2 = 0 THEN d END", "CASE WHEN p_partkey % 2 = 0 THEN b END", "'Technologies : ' || CASE WHEN p_partkey % 6 <> 0 THEN d || ', x' ELSE '' END")} AS text """
    f"FROM (SELECT p_partkey, a, b, c, coalesce(d, '') AS e, d FROM {_P})".replace("d || ', x' ELSE ''", "e || ', x' ELSE ''")
)
def text_experience(spark, sf):
    """With a first project for every second row."""
    p = _parts(spark, sf, start_date="a", end_date="b", company="c", location="d", role="a", mission_type="b", context="c", objective="a", problem="b", solution="c", results="d", impact="b")
    first = F.struct(*["objective", "problem", "solution", "results", "impact"])
    even, sixth = F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 6 != 0
    p = p.withColumn("projects", F.when(even, F.array(first, first)).when(F.col("p_partkey") % 3 == 0, F.array().cast("array<struct<objective:string,problem:string,solution:string,results:string,impact:string>>")))
    p = p.withColumn("technologies", F.when(sixth, F.array(F.coalesce("location", F.lit("")), F.lit("x"))))
    return p.select("p_partkey", ingest.experience_text().alias("text"))


@_register(f"""SELECT p_partkey, {_JOINED("'Projet : ' || coalesce(a, '')", "'Date : ' || coalesce(b, '') || ' à ' || coalesce(c, '')", "d", "'Objectif : ' || coalesce(a, '')", "'Problème : ' || coalesce(b, '')", "'Solution : ' || coalesce(c, '')", "'Résultats : ' || coalesce(d, '')", "'Impact : ' || coalesce(a, '')", "'Stack : ' || coalesce(b, '')")} AS text FROM {_P}""")
def text_project(spark, sf):
    """F4."""
    return _parts(spark, sf, name="a", start_date="b", end_date="c", description="d", objective="a", problem="b", solution="c", results="d", impact="a", stack="b").select("p_partkey", ingest.project_text().alias("text"))


@_register(f"""SELECT p_partkey, {_JOINED("coalesce(a, '') || ' à ' || coalesce(b, '')", "'Date : ' || coalesce(c, '') || ' à ' || coalesce(d, '')", "'Domaine : ' || coalesce(a, '')", "b", "'Apprentissages clés : ' || coalesce(c, '')")} AS text FROM {_P}""")
def text_formation(spark, sf):
    """F4."""
    return _parts(spark, sf, degree="a", institution="b", start_date="c", end_date="d", field="a", description="b", key_learnings="c").select("p_partkey", ingest.formation_text().alias("text"))


# ---- operators that had no query of their own

_MAP = "(SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS providers FROM (SELECT user_id, event_type, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY user_id)"
_AS_TEXT = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")


@_register(f"SELECT user_id, providers FROM {_MAP.format(src='events')}")
def provider_map(spark, sf):
    """A5 as a map (shown as text)."""
    m = accounting.provider_map(_t(spark, sf, "events"), "user_id", "event_type")
    return m.select("user_id", _AS_TEXT(F.col("providers_used")).alias("providers"))


@_register(
    f"WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ({_LOG})), "
    "f AS (SELECT user_id, 1::BIGINT AS n, lat AS tokens, lat AS avg, round(cost, 6)::DECIMAL(10,6) AS cost FROM l WHERE rn = 1 UNION ALL "
    "SELECT f.user_id, f.n + 1, f.tokens + l.lat, (f.avg * f.n + l.lat) // (f.n + 1), (f.cost::DOUBLE + l.cost)::DECIMAL(10,6) FROM f JOIN l ON l.user_id = f.user_id AND l.rn = f.n + 1) "
    f"SELECT user_id, n AS question_count, tokens::BIGINT AS total_tokens, cost::DOUBLE AS total_cost, avg AS avg_latency_ms, providers FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM f) "
    f"JOIN {_MAP.format(src='(SELECT * FROM events WHERE value IS NOT NULL)')} USING (user_id) WHERE r = 1"
)
def chat_session_rows(spark, sf):
    """K3 A1-A5: the whole session row, rounded at every step."""
    r = accounting.session_rows(_log(spark, sf), "user_id", ["ts", "event_id"], "lat", "cost", "lat", "event_type")
    return r.select("user_id", "question_count", "total_tokens", F.col("total_cost").cast("double"), "avg_latency_ms", _AS_TEXT(F.col("providers_used")).alias("providers"))


_TALK = "SELECT conv_id AS user_id, turn AS ts, turn AS event_id, length(text)::BIGINT AS lat, length(text) / 999983.0::DOUBLE AS cost, role AS event_type FROM conversations"


@_register(SQL["chat_session_rows"].replace(_LOG, _TALK).replace("(SELECT * FROM events WHERE value IS NOT NULL)", f"({_TALK})"))
def session_rows_by_bucket(spark, sf):
    """Session rows after three appends in an order that is not that of the turns; each renews the buckets it touches."""
    n = F.length("text")
    t = _t(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.timestamp_seconds("turn").cast("timestamp_ntz").alias("ts"), F.col("turn").alias("event_id"), n.alias("tokens"), n.alias("latency"), (n / 999983.0).alias("cost"), F.col("role").alias("provider"))
    path = f"{merge.shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    for k in (1, 2, 0):
        incremental.append(t.where(F.col("event_id") % 3 == k), path, buckets=16)
    r = incremental.sessions(spark, path).withColumnRenamed("session_id", "user_id")
    return r.select("user_id", "question_count", "total_tokens", F.col("total_cost").cast("double"), "avg_latency_ms", _AS_TEXT(F.col("providers_used")).alias("providers"))


@_register(SQL["chat_transcript"])
def recorded_transcript(spark, sf):
    """K1 K2: log and transcript written together in three batches, one of which runs again, and read back."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf, "conversations").where("role <> 'system'").withColumns({"nr": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    p = t.where("role = 'user' and nr = 'assistant'").select(
        F.col("turn").cast("string").alias("query_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("query_text"), F.col("answer").alias("response"), F.length("answer").alias("tokens_used"), F.lit(None).cast("timestamp").alias("created_at"),
        F.array().cast("array<struct<id:bigint,type:string,score:double>>").alias("retrieved_chunks"), F.lit(0.0).alias("retrieval_s"), F.lit(0.0).alias("generation_s"), F.lit("p").alias("provider_used"), F.lit(0).alias("embedding_tokens"), F.lit(0.0).alias("cost"),
    )
    sink = sinks.turns_sink(f"{merge.shared_dir(spark)}/turns-{uuid.uuid4().hex}", 0.13)
    for k in (0, 1, 2, 1):
        sink(p.where(F.col("query_id").cast("long") % 3 == k), k)
    return sink.read(spark, "chat_messages").select(F.col("session_id").cast("bigint").alias("conv_id"), F.col("query_id").cast("bigint").alias("turn"), "seq", "role", "content", "tokens_used")


@_register(f"WITH {_CORPORA} SELECT string_agg(type || '-' || id || '-' || round(score, 6)::DECIMAL(8,6), ' ' ORDER BY score DESC, type, id) AS chunks, count(*) AS nb_chunks_retrieved FROM kept")
def logged_chunks(spark, sf):
    """What the log keeps of the chunks."""
    got = retrieval.log_chunks(_hits(spark, sf), [])
    text = F.array_join(F.transform("retrieved_chunks", lambda c: F.concat(c["type"], F.lit("-"), c["id"].cast("string"), F.lit("-"), c["score"].cast("decimal(8,6)").cast("string"))), " ")
    return got.select(text.alias("chunks"), F.col("nb_chunks_retrieved"))


_TURNS = "SELECT event_id, user_id, abs(value) / 7 AS r, abs(value) / 3 AS g, floor(abs(value))::INT AS tokens FROM events WHERE value IS NOT NULL"


@_register(f"SELECT event_id, trunc(r * 1000)::INT AS latency_retrieval_ms, trunc(g * 1000)::INT AS latency_generation_ms, (trunc(r * 1000) + trunc(g * 1000))::INT AS latency_total_ms, (tokens * 0.13 / 1e6)::DECIMAL(10,6)::DOUBLE AS embedding_cost, (tokens * 0.13 / 1e6 + g / 1000)::DECIMAL(10,6)::DOUBLE AS total_cost FROM ({_TURNS})")
def query_log_rows(spark, sf):
    """Latencies truncated to milliseconds, costs to six decimals."""
    e = _t(spark, sf, "events").where("value is not null")
    v = F.abs("value")
    turns = e.select(
        F.col("event_id").alias("query_id"), F.col("user_id").alias("session_id"), F.lit("").alias("query_text"), F.array().cast("array<string>").alias("retrieved_chunks"), F.col("ts").alias("created_at"), F.lit("p").alias("provider_used"),
        F.floor(v).cast("int").alias("embedding_tokens"), F.lit(0).alias("tokens_used"), (v / 3 / 1000).alias("cost"), (v / 7).alias("retrieval_s"), (v / 3).alias("generation_s"),
    )
    log = accounting.query_log(turns, 0.13)
    return log.select(F.col("query_id").alias("event_id"), "latency_retrieval_ms", "latency_generation_ms", "latency_total_ms", F.col("embedding_cost").cast("double"), F.col("total_cost").cast("double"))


@_register("SELECT DISTINCT p_partkey AS owner, s_suppkey AS skill_id FROM part JOIN supplier ON lower('SUPPLIER#' || lpad((p_partkey % 150)::VARCHAR, 9, '0')) = lower(trim(s_name))")
def skill_links(spark, sf):
    """Look-up by normalised name; names that match nothing vanish."""
    owners = _t(spark, sf, "part").select(F.col("p_partkey").alias("owner"), F.concat(F.lit(" SUPPLIER#"), F.lpad((F.col("p_partkey") % 150).cast("string"), 9, "0"), F.lit(" ")).alias("name"))
    skills = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return ingest.link_skills(owners, skills, "owner")


@_register("SELECT o_orderkey AS exp_idx, i - 1 AS pos, w[i] AS name FROM (SELECT o_orderkey, string_split(o_orderpriority, '-') AS w, unnest(range(1, len(string_split(o_orderpriority, '-')) + 1)) AS i FROM orders)")
def nested_projects(spark, sf):
    """Nested records with their parent's and their own ordinal."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("exp_idx"), F.transform(F.split("o_orderpriority", "-"), lambda x: F.struct(x.alias("name"))).alias("projects"))
    return ingest.child_projects(o).select("exp_idx", F.col("pos").cast("bigint"), "name")


@_register("SELECT name FROM (SELECT name, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY src, id) AS rn FROM (SELECT 0 AS src, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 1, r_regionkey, lower(r_name) FROM region UNION ALL SELECT 2, n_nationkey, lower(n_name) FROM nation)) WHERE rn = 1")
def skill_sources(spark, sf):
    """Several sources one after the other, of equal names the first."""
    rows = lambda t, k, name: _t(spark, sf, t).select(F.col(k).alias("id"), name.alias("name"), F.lit(None).cast("string").alias("category"), F.lit("").alias("proficiency_level"))
    found = ingest.unique_skills([rows("nation", "n_nationkey", F.col("n_name")), rows("region", "r_regionkey", F.lower("r_name")), rows("nation", "n_nationkey", F.lower("n_name"))], ["id"])
    return found.select("name")


@_register("SELECT vec_id, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 2)::FLOAT::DOUBLE))::DECIMAL(18,4)::DOUBLE AS total FROM embeddings WHERE embedding IS NOT NULL")
def rounded_vectors(spark, sf):
    """F13."""
    v = T.vector_rounded(F.col("embedding"), 2)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return _t(spark, sf, "embeddings").where("embedding is not null").select("vec_id", total.cast("decimal(18,4)").cast("double").alias("total"))


@_register(
    "SELECT p_partkey, len(list_filter(string_split(p_type, ' '), lambda x: nullif(x, '') IS NOT NULL))::BIGINT AS items, regexp_extract('/a/' || p_name || '/' || p_brand, '[^/]+$') AS base, "
    "coalesce(nullif(CASE WHEN p_size < 10 THEN '' WHEN p_size > 40 THEN NULL ELSE p_type END, ''), 'Autres') AS kind, (octet_length(encode(repeat(p_type, p_size * 5))) // 1024)::BIGINT AS kb FROM part"
)
def small_functions(spark, sf):
    """F15 F26 F27 F28."""
    c = F.col
    items = F.size(F.filter(T.blank_items_null(F.split("p_type", " ")), lambda x: x.isNotNull())).cast("bigint")
    kind = T.falsy_default(F.when(c("p_size") < 10, F.lit("")).when(c("p_size") <= 40, c("p_type")), "Autres")
    return _t(spark, sf, "part").select("p_partkey", items.alias("items"), T.basename(F.concat(F.lit("/a/"), "p_name", F.lit("/"), "p_brand")).alias("base"), kind.alias("kind"), T.kilobytes(F.encode(F.repeat("p_type", c("p_size") * 5), "UTF-8")).alias("kb"))


@_register("SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN greatest(0, 86400000 - event_id * 7919)::BIGINT END AS remaining_ms FROM events")
def cooldown_left(spark, sf):
    """What is left of a day's cooldown."""
    return _t(spark, sf, "events").select("event_id", quota.remaining_ms((F.col("event_id") % 5), F.lit(0).cast("bigint"), F.col("event_id") * 7919, 3, 24 * HOUR_MS).alias("remaining_ms"))


@_register("SELECT url AS filename, page_id AS page_number FROM pages WHERE page_id = 7 ORDER BY url LIMIT 1")
def page_lookup(spark, sf):
    """One page by number."""
    p = _t(spark, sf, "pages").select(F.col("url").alias("filename"), F.col("page_id").alias("page_number"))
    return assets.page(p, 7)


@_register("SELECT url AS filename FROM pages ORDER BY page_id LIMIT 1")
def first_file(spark, sf):
    """One file, the first by id."""
    return assets.first_file(_t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("filename"))).select("filename")
