"""Services asked once and paced, recorded answers, the cache table, migrations, pages as a table function."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sparkloom import models, schemas
from sparkloom.operators import accounting, merge, migrations, pruned, retrieval
from sparkloom.plans import answering, seeding
from sparkloom.sources import assets
from sparkloom.sources.cache import VectorCache


class Counting(models.HashEmbedder):
    """Notes every text in a file, as calls are made in other processes; fails for some."""

    name = "counting"

    def __init__(self, path, fail=0, dim=8):
        super().__init__(dim)
        self.path, self.fail = str(path), fail

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if self.fail and sum(1 for _ in open(self.path)) <= self.fail:
            raise models.Unavailable("busy")
        return super().embed(texts)

    def calls(self):
        return open(self.path).read().split() if os.path.exists(self.path) else []


class Hanging(models.HashEmbedder):
    name = "hanging"

    def embed(self, texts):
        time.sleep(60)


def test_each_question_is_embedded_once_and_recorded(spark, tmp_path):
    e = Counting(tmp_path / "calls")
    docs = models.embed_texts(spark.createDataFrame([(k, f"w{k}") for k in range(6)], "id int, t string"), "t", models.HashEmbedder(8))
    corpus = retrieval.corpus(docs, "formation", F.col("id"), F.col("t"), F.col("t"))
    q = spark.createDataFrame([(f"s{k % 4}", f"w{k}") for k in range(9)], "session_id string, query_text string").withColumn("created_at", F.current_timestamp())
    a = answering.answer(q, corpus, spark.createDataFrame([("template", 1.0)], "model string, price double"), e, [models.TemplateGenerator()], settings=answering.Settings(threshold=0.9))
    log = a.log.collect()
    assert len(log) == 6 and a.unanswered.count() == 3 and a.answered.count() == 6
    assert sorted(e.calls()) == sorted(f"w{k}" for k in range(9))
    assert all(r["latency_retrieval_ms"] > 0 and r["latency_total_ms"] >= r["latency_retrieval_ms"] for r in log)
    ids = {r["query_id"] for r in log}
    assert len(ids) == 6 and ids == {r["query_id"] for r in a.log.collect()}
    folder = str(tmp_path / "db")
    for batch in (0, 0, 1, 1):  # a batch that is run again adds nothing
        answering.record(a, folder, batch)
    sink = answering.sinks.turns_sink(folder, answering.SETTINGS.embedding_price, "batch")
    assert sink.read(spark, "retrieval_logs").count() == 12 and sink.read(spark, "chat_messages").count() == 24
    rows = {r["session_id"]: r for r in spark.read.parquet(f"{folder}/chat_sessions").collect()}
    assert sum(r["question_count"] for r in rows.values()) == 12
    want = {r["session_id"]: r["question_count"] * 2 for r in a.sessions.collect()}
    assert {k: r["question_count"] for k, r in rows.items()} == want


def test_answers_over_an_index_are_the_same(spark, tmp_path):
    e = models.HashEmbedder(8)
    docs = models.embed_texts(spark.createDataFrame([(k, f"w{k}") for k in range(60)], "id int, t string"), "t", e)
    corpus = retrieval.corpus(docs, "formation", F.col("id"), F.col("t"), F.col("t"))
    q = spark.createDataFrame([(f"q{k}", "s", f"w{k}") for k in range(0, 90, 7)], "query_id string, session_id string, query_text string").withColumn("created_at", F.current_timestamp())
    prices = spark.createDataFrame([("template", 1.0)], "model string, price double")
    index = pruned.build(corpus, str(tmp_path / "i"))
    plain, over = (answering.answer(q, corpus, prices, e, [models.TemplateGenerator()], settings=answering.Settings(threshold=0.8, top_k=4), index=i) for i in (None, index))
    for name in ("answered", "unanswered"):
        a, b = (sorted(map(repr, getattr(x, name).select("query_id", *(["context", "retrieved_chunks"] if name == "answered" else [])).collect())) for x in (plain, over))
        assert a == b and a


def test_paced_calls(spark, tmp_path):
    e = Counting(tmp_path / "calls")
    clock = tmp_path / "clock"
    clock.write_text("0")

    def now():
        return float(clock.read_text())

    def sleep(s):
        clock.write_text(str(now() + s))

    df = spark.createDataFrame([(k, None if k == 20 else f"t{k % 10}") for k in range(21)], "k int, t string")
    out = models.embed_paced(df, "t", e, batch=3, pause_s=2.0, now=now, sleep=sleep)
    assert out.count() == 21 and out.where("embedding is null").count() == 1 and out.count() == 21
    assert sorted(e.calls()) == [f"t{k}" for k in range(10)]
    assert now() == 6.0  # four calls, two seconds apart
    clock.write_text("0")
    busy = Counting(tmp_path / "busy", fail=10)
    out = models.embed_paced(df, "t", busy, batch=10, pause_s=0.5, retries=2, backoff_s=1.0, now=now, sleep=sleep)
    assert out.where("embedding is not null").count() == 20 and len(busy.calls()) == 20 and now() == 1.0
    never = Counting(tmp_path / "never", fail=10**6)
    out = models.embed_paced(df, "t", never, batch=10, retries=1, backoff_s=0, error="why", now=now, sleep=sleep)
    assert {r["why"] for r in out.where("t is not null").collect()} == {"counting: busy"} and len(never.calls()) == 20


def test_time_limits(spark):
    df = spark.createDataFrame([("a",)], "t string")
    began = time.time()
    r = models.embed_texts(df, "t", Hanging(4), error="why", timeout_s=0.3, seconds="s").first()
    assert r["embedding"] is None and "within 0.3 s" in r["why"] and 0.3 <= r["s"] < 5 and time.time() - began < 30
    assert "within" in models.embed_paced(df, "t", Hanging(4), timeout_s=0.2, retries=0, error="why").first()["why"]


@pytest.fixture
def cache(spark):
    c = VectorCache(spark, "cache_of_tests", buckets=4)
    spark.sql("drop table if exists cache_of_tests")
    yield c
    spark.sql("drop table if exists cache_of_tests")


def test_cache_table(spark, tmp_path, cache):
    e = Counting(tmp_path / "calls")
    texts = spark.createDataFrame([(f"t{k}",) for k in range(40)], "t string")
    assert cache.read().count() == 0
    _, fresh = models.embed_cached(texts, cache.read(), "t", e)
    assert cache.append(fresh) == 40 and cache.append(fresh) == 0
    got, none = models.embed_cached(texts, cache.read(), "t", e)
    assert none.count() == 0 and got.count() == 40 and len(e.calls()) == 40
    assert cache.append(models.embed_cached(spark.createDataFrame([("new",)], "t string"), cache.read(), "t", e)[1]) == 1
    cache.compact()
    assert cache.read().count() == 41 and cache.read().select("md5").distinct().count() == 41
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits, _ = models.cache_split(texts, cache.read(), "t", e.name)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert plan.count("Exchange hashpartitioning(md5") == 1  # that of the texts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_damaged_cache_is_embedded_again(spark, tmp_path, cache):
    e = Counting(tmp_path / "calls")
    texts = spark.createDataFrame([(f"t{k}",) for k in range(40)], "t string")
    cache.append(models.embed_cached(texts, cache.read(), "t", e)[1])
    files = sorted(f.removeprefix("file:") for f in spark.table("cache_of_tests").inputFiles())
    with open(files[0], "wb") as f:
        f.write(b"no parquet")
    os.remove(files[1])
    left = cache.read().count()
    assert 0 < left < 40
    got, fresh = models.embed_cached(texts, cache.read(), "t", e)
    assert got.count() == 40 and fresh.count() == 40 - left and len(e.calls()) == 80 - left


def test_second_ingest_embeds_nothing(spark, tmp_path, cache):
    files = {"formations": str(tmp_path / "f.json"), "informations": str(tmp_path / "i.json")}
    (tmp_path / "f.json").write_text('[{"institution": "z", "degree": "b"}, {"institution": "a", "degree": "a"}]')
    (tmp_path / "i.json").write_text('[{"nom": "z", "prenom": "y"}, {"nom": "b", "prenom": "a"}]')
    e = Counting(tmp_path / "calls")
    made = seeding.seed(spark, files, e, cache.read())
    seeding.load(made, str(tmp_path / "db"), cache)
    t = {k: spark.read.parquet(str(tmp_path / "db" / k)).orderBy("id").collect() for k in ("formations", "informations")}
    assert [(r["id"], r["institution"]) for r in t["formations"]] == [(1, "z"), (2, "a")]  # the order of the file
    assert [(r["id"], r["nom"]) for r in t["informations"]] == [(1, "z"), (2, "b")]
    n = len(e.calls())
    assert cache.read().count() == 4
    again = seeding.seed(spark, files, e, cache.read())
    seeding.load(again, str(tmp_path / "db"), cache)
    assert len(e.calls()) == n and cache.read().count() == 4


SCRIPTS = {
    "002_more.sql": "-- a comment; with a sign\nalter table m_users add columns (city string default 'a;b');\ninsert into m_users values (2, 'two', 'c');",
    "001_first.sql": "create table if not exists m_users (id int, name string) using parquet; insert into m_users values (1, 'o''ne; x') /* all; of it */;",
}


def test_migrations(spark):
    for t in ("m_users", "m_ledger"):
        spark.sql(f"drop table if exists {t}")
    assert migrations.applied(spark, "m_ledger") == []
    broken = {**SCRIPTS, "002_more.sql": SCRIPTS["002_more.sql"].replace("insert into m_users values (2", "insert into none_such values (2")}
    with pytest.raises(Exception, match="none_such"):
        migrations.run(spark, broken, "m_ledger")
    assert migrations.applied(spark, "m_ledger") == ["001_first.sql"]
    # the run after it goes on with the statement that failed
    assert migrations.run(spark, SCRIPTS, "m_ledger") == ["002_more.sql"]
    assert migrations.run(spark, SCRIPTS, "m_ledger") == []
    assert sorted(map(tuple, spark.table("m_users").collect())) == [(1, "o'ne; x", "a;b"), (2, "two", "c")]
    assert migrations.applied(spark, "m_ledger") == ["001_first.sql", "002_more.sql"]
    with pytest.raises(ValueError, match="changed"):
        migrations.run(spark, {**SCRIPTS, "001_first.sql": "select 1"}, "m_ledger")


def test_pages_as_a_table_function(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"abcdef")), ("b.pdf", bytearray(b"")), ("c.pdf", bytearray(b"xy"))], "filename string, file_data binary")
    render = lambda data: [(data[k : k + 2], 10 + k, 20) for k in range(0, len(data), 2)]
    assets.register_pages(spark, render, "pages_of_tests")
    files.unionByName(spark.createDataFrame([("none", None)], files.schema)).createOrReplaceTempView("files_of_tests")
    got = spark.sql("select f.filename, p.* from files_of_tests f, lateral pages_of_tests(f.file_data) p")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, assets.render_pages(files, render).collect()))


def test_shaped_rows(spark):
    df = merge.shaped(spark.createDataFrame([(1,)], "a int"), "b string, a bigint")
    assert df.dtypes == [("b", "string"), ("a", "bigint")] and accounting.json_text is not None and schemas.TABLES
