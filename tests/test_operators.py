"""Ingest, merges, accounting, quota, models and assets on small data."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from sparkloom import models, schemas
from sparkloom.operators import accounting, merge, quota, retrieval
from sparkloom.functions import text
from sparkloom.plans import answering, seeding
from sparkloom.session import alive
from sparkloom.sources import assets, ingest


def test_ingest(spark, tmp_path):
    data = [
        {"company": "A", "role": "r", "start_date": "2020-01-01", "context": "c", "technologies": ["x", "y"], "skills": ["Python", {"name": "sql", "category": "Data", "proficiency_level": ""}], "projects": [{"name": "p1", "description": "d", "objective": "why", "problem": "", "results": "done"}, {"name": "p2", "objective": "other"}], "duration_months": None},
        {"company": "B", "role": None, "skills": [" python "], "projects": []},
        {"company": "C", "location": "L", "skills": ["", "Go"]},
    ]
    (tmp_path / "e.json").write_text(json.dumps(data))
    e = ingest.numbered(ingest.load_json(spark, str(tmp_path / "e.json"), schemas.EXPERIENCES_JSON))
    assert [r[0] for r in e.orderBy("exp_idx").select(ingest.experience_text()).collect()] == [
        "Date : 2020-01-01 à  | Entreprise : A, None | Rôle : r | Type :  | c | why | done | Technologies : x, y",
        "Date :  à  | Entreprise : B, None | Rôle :  | Type :  | Technologies : ",
        "Date :  à  | Entreprise : C, L | Rôle :  | Type :  | Technologies : ",
    ]
    assert [(r["exp_idx"], r["pos"], r["name"]) for r in ingest.child_projects(e).orderBy("exp_idx", "pos").collect()] == [(1, 0, "p1"), (1, 1, "p2")]
    raw = e.select("exp_idx", F.posexplode("skills").alias("pos", "raw"))
    rows = ingest.skill_rows(raw, "raw", ["exp_idx", "pos"])
    u = ingest.unique_skills([rows], ["exp_idx", "pos"])
    assert sorted((r["name"], r["category"], r["proficiency_level"]) for r in u.collect()) == [("Go", "Programmation", "Intermédiaire"), ("Python", "Programmation", "Intermédiaire"), ("sql", "Data", "Intermédiaire")]
    skills = merge.surrogate_keys(u.select("name"), ["name"])
    assert sorted((r["id"], r["name"]) for r in skills.collect()) == [(1, "Go"), (2, "Python"), (3, "sql")]
    links = ingest.link_skills(rows, skills, "exp_idx")
    assert sorted(tuple(r) for r in links.collect()) == [(1, 2), (1, 3), (2, 2), (3, 1)]
    assert sorted(tuple(r) for r in ingest.link_skills(rows, skills, "exp_idx", exact=True).collect()) == [(1, 2), (1, 3), (3, 1)]
    assert ingest.load_json(spark, str(tmp_path / "none.json"), schemas.FORMATIONS_JSON).count() == 0


def test_schemas_parse(spark):
    for ddl in schemas.TABLES.values():
        assert spark.createDataFrame([], ddl).count() == 0
    assert alive(spark)


def test_corpora_keep_fanout_and_null_descriptions(spark):
    row = lambda ddl, **kw: [tuple(kw.get(c.split()[0]) for c in _cols(ddl))]
    v = [1.0, 0.0]
    exp = spark.createDataFrame(row(schemas.EXPERIENCES, id=1, company="c", role="r", start_date=date(2020, 1, 1), end_date=date(2021, 1, 1), context="x", embedding=v) + row(schemas.EXPERIENCES, id=2, role="open", embedding=v) + row(schemas.EXPERIENCES, id=3, role="no vector"), schemas.EXPERIENCES)
    pro = spark.createDataFrame(row(schemas.PROJECTS, id=1, experience_id=1, name="a", objective="o", problem="p", solution="s", results="r", impact="i", description="b") + row(schemas.PROJECTS, id=2, experience_id=1, name="c", description="d"), schemas.PROJECTS)
    frm = spark.createDataFrame(row(schemas.FORMATIONS, id=1, degree="deg", embedding=[0.0, 0.0]), schemas.FORMATIONS)
    inf = spark.createDataFrame(row(schemas.INFORMATIONS, id=1, nom="n", prenom="p", prononciation="q", pays_naissance="z", date_naissance=date(2000, 1, 2), passion="x", embedding=[0.0, 1.0]), schemas.INFORMATIONS)
    c = retrieval.profile_corpora(exp, pro, frm, inf)
    hits = retrieval.search(c, [1.0, 0.0], 20).collect()
    assert [(h["type"], h["id"], h["child_id"]) for h in hits] == [("formation", 1, None), ("experience", 1, 1), ("experience", 1, 2), ("experience", 2, None), ("information", 1, None)]
    assert hits[1]["description"] == "2020-01-01 à 2021-01-01 description : x o p s r i b"
    assert hits[2]["description"] is None and hits[3]["description"] is None  # a project without its texts, and none
    assert (hits[4]["title"], hits[4]["description"]) == ("je suis p n avec le prenom prononcé q né à z le 2000-01-02", "Passioné depuis par les sciences dures et les nouvelles technologies, aussi je suis x")
    kept = retrieval.relevant(retrieval.search(c, [1.0, 0.0], 20))
    assert kept.count() == 3 and retrieval.sources(kept, 2).count() == 2
    assert retrieval.prompt_context(kept).first()["context"].endswith("[EXPERIENCE] open\n")
    many = retrieval.search_many(c, spark.createDataFrame([(q, [1.0, 0.0]) for q in range(5)], "query_id int, query_embedding array<float>"), 2, broadcast_rows=2)
    assert many.count() == 10 and many.where("rank > 2").count() == 0
    assert retrieval.profile_corpora(exp, pro, frm, inf, with_projects=True).count() == c.count()


def _cols(ddl):
    depth, out, at = 0, [], ""
    for ch in ddl:
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and not depth:
            out.append(at.strip())
            at = ""
        else:
            at += ch
    return [*out, at.strip()]


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, s int")
    up = merge.upsert(old, new, ["k"], ["s"])
    want = [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, up.collect())) == want
    assert sorted(map(tuple, merge.upsert(up, new, ["k"], ["s"]).collect())) == want
    assert sorted(r["k"] for r in merge.insert_ignore(old, new, ["k"]).collect()) == [1, 2, 3]
    assert merge.duplicates(new, ["k"]).count() == 1
    path = str(tmp_path / "t")
    for df in (old, up):
        merge.replace_table(df, path)
        assert spark.read.parquet(path).count() == df.count()
    assert merge.applied(spark.createDataFrame([("x.sql",)], "filename string"), "x.sql")
    assert merge.touch(old).where("updated_at is null").count() == 0


def test_exact_fold_differs_from_means(spark):
    log = spark.createDataFrame([(1, 1, 10, 4e-7), (1, 2, 11, 4e-7), (1, 2, 13, 6e-7)], "s int, t int, lat long, cost double").withColumn("x", F.monotonically_increasing_id())
    r = accounting.session_metrics_exact(log, "s", ["t", "x"], "cost", "lat").first()
    assert (r["question_count"], r["avg_latency_ms"], float(r["total_cost"])) == (3, 11, 0.000001)
    assert accounting.provider_map(log.withColumn("p", F.lit("a")), "s", "p").first()["providers_used"] == {"a": 3}


def test_quota_step():
    assert quota.step(0, None, 0, 3, 30) == (1, 0, True, False)
    assert quota.step(3, 100, 129, 3, 30) == (3, 100, False, False)
    assert quota.step(3, 100, 130, 3, 30) == (1, 130, True, True)


def test_remaining(spark):
    r = lambda c, last, now: spark.range(1).select(quota.remaining_ms(F.lit(c), F.lit(last).cast("bigint"), F.lit(now).cast("bigint"), 3, 30)).first()[0]
    assert (r(2, 0, 5), r(3, 0, 5), r(3, 0, 50)) == (None, 25, 0)


class FileSystem:
    """Folders as a set; renames to the names in `broken` fail."""

    def __init__(self, *folders, broken=()):
        self.folders, self.broken = set(folders), set(broken)

    def exists(self, path):
        return path in self.folders

    def rename(self, a, b):
        if b in self.broken or a not in self.folders or b in self.folders:
            return False
        self.folders.remove(a)
        self.folders.add(b)
        return True

    def delete(self, path, recursive):
        self.folders.remove(path)


def test_failed_renames_leave_the_old_table():
    fs = FileSystem("t", "new")
    merge.swap(fs, "t", "new", "old")
    assert fs.folders == {"t"}
    for broken in ({"old"}, {"t"}):
        fs = FileSystem("t", "new", broken=broken)
        fs.rename = (lambda f: lambda a, b: f(a, b) if (a, b) != ("old", "t") else fs.folders.remove(a) or fs.folders.add(b) or True)(fs.rename)  # the way back is open
        with pytest.raises(OSError):
            merge.swap(fs, "t", "new", "old")
        assert fs.folders == {"t", "new"}
    fs = FileSystem("new", broken={"t"})
    with pytest.raises(OSError):
        merge.swap(fs, "t", "new", "old")
    assert fs.folders == {"new"}


class Failing:
    name = "failing"

    def generate(self, system, user):
        raise RuntimeError("down")

    def embed(self, texts):
        raise models.Unavailable("down")


class Slow(models.TemplateGenerator):
    name = "slow"

    def generate(self, system, user):
        import time

        time.sleep(1.5)
        return "late", 1


class Keyless(models.TemplateGenerator):
    name, key = "keyless", ""


class Broken(models.HashEmbedder):
    def embed(self, texts):
        return texts[0] + 1


def test_models(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    cache = spark.createDataFrame([], schemas.EMBEDDINGS_CACHE)
    got, fresh = models.embed_cached(texts, cache, "t", models.HashEmbedder(4))
    assert got.count() == 2 and fresh.count() == 2
    _, again = models.embed_cached(texts, fresh, "t", models.HashEmbedder(4))
    assert again.count() == 0
    _, none = models.embed_cached(texts, cache, "t", Failing())
    assert none.count() == 0
    assert {r["why"] for r in models.embed_texts(texts, "t", Failing(), error="why").where("embedding is null").collect()} == {"failing: down"}
    with pytest.raises(Exception, match="TypeError"):  # a bug is no outage
        models.embed_texts(texts, "t", Broken()).collect()
    q = spark.createDataFrame([("s", "u")], "s string, u string")
    r = models.generate(q, "s", "u", [Failing(), Keyless(), Slow(), models.TemplateGenerator()], timeout_s=0.3).first()
    assert r["provider_used"] == "template" and r["latency_ms"] < 300
    r = models.generate(q, "s", "u", [Failing(), Slow()], timeout_s=0.3).first()
    assert r["response"] is None and "down" in r["error"] and "slow" in r["error"]
    assert models.generate(q, "s", "u", [Keyless()]).first()["error"] == "no provider with a key"


def test_answering_branches(spark):
    q = spark.createDataFrame([("1", "s", "hello"), ("2", "s", "   "), ("3", "s", "other"), ("4", "s", "hello")], "query_id string, session_id string, query_text string").withColumn("created_at", F.current_timestamp())
    e = models.HashEmbedder(8)
    docs = models.embed_texts(spark.createDataFrame([(1, "hello")], "id int, t string"), "t", e)
    corpus = retrieval.corpus(docs, "formation", F.col("id"), F.col("t"), F.col("t"))
    prices = spark.createDataFrame([("template", 1.0)], "model string, price double")
    settings = answering.Settings(threshold=0.9)
    a = answering.answer(q, corpus, prices, e, [models.TemplateGenerator()], settings=settings)
    assert sorted(r["query_id"] for r in a.answered.collect()) == sorted(r["query_id"] for r in a.log.collect()) == ["1", "4"]
    assert a.answered.first()["user"].startswith("Contexte :\n[FORMATION] hello\nhello\n\nQuestion : hello\n\n")
    assert [(r["query_id"], r["provider_used"], r["response"]) for r in a.unanswered.collect()] == [("3", "none", retrieval.APOLOGY)]
    assert [r["query_id"] for r in a.rejected.collect()] == ["2"] and a.failed.count() == 0
    row, log = a.sessions.first(), a.log.collect()
    assert (row["question_count"], row["total_tokens"], row["providers_used"]) == (2, sum(r["llm_tokens"] + 1 for r in log), {"template": 2})
    a = answering.answer(q, corpus, prices, e, [Failing()], settings=settings)
    assert sorted((r["query_id"], r["error"]) for r in a.failed.collect()) == [("1", "failing: down"), ("4", "failing: down")]
    assert a.answered.count() == a.log.count() == a.sessions.count() == 0


def test_session_rows(spark):
    log = spark.createDataFrame([(1, 1, 1, 5, 10, 4e-7, "a"), (1, 2, 2, 6, 11, 4e-7, "b'\""), (1, 2, 3, None, 13, 6e-7, "a"), (2, 1, 4, 1, 7, 1.0, None)], "s int, t int, x int, tok long, lat long, cost double, p string")
    got = {r["s"]: r for r in accounting.session_rows(log, "s", ["t", "x"], "tok", "cost", "lat", "p").withColumn("j", accounting.json_text(F.col("providers_used"))).collect()}
    assert tuple(got[1])[1:3] == (3, 11) and float(got[1]["total_cost"]) == 0.000001 and got[1]["avg_latency_ms"] == 11
    assert got[1]["providers_used"] == json.loads(got[1]["j"]) == {"a": 2, "b'\"": 1} and got[2]["providers_used"] == {}


def test_seeding(spark, tmp_path):
    exp = [
        {"company": "Été", "role": "r", "start_date": "2020-01-01", "end_date": "", "location": "x", "technologies": ["a", ""], "skills": ["Python", {"name": "SQL", "category": "Data"}],
         "projects": [{"name": "p1", "skills": ["Python", "none such"]}, {"name": "p2", "duration_months": None, "skills": []}]},
        {"company": "B", "skills": ["python", "SQL"], "projects": []},
    ]
    skills = ["Python", {"name": "SQL", "category": "Old", "proficiency_level": "x"}, "Go"]
    infos = [{"nom": "n", "prenom": "p", "date_naissance": "2000-01-02"}]
    files = {}
    for name, data in (("experiences", exp), ("skills", skills), ("informations", infos)):
        files[name] = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    out = str(tmp_path / "db")
    made = seeding.seed(spark, files, models.HashEmbedder(4))
    seeding.load(made, out)
    t = {k: spark.read.parquet(f"{out}/{k}") for k in made.tables}
    assert {k: v.count() for k, v in t.items()} == {"skills": 4, "informations": 1, "experiences": 2, "formations": 0, "projects": 2, "experience_skills": 3, "project_skills": 2}
    names = {r["id"]: (r["name"], r["category"]) for r in t["skills"].collect()}
    # of equal names the last category stands; a spelling that lost to another has no link
    assert sorted(names.values()) == [("Go", "Programmation"), ("Python", "Programmation"), ("SQL", "Programmation"), ("none such", "Programmation")]
    assert sorted((r["experience_id"], names[r["skill_id"]][0]) for r in t["experience_skills"].collect()) == [(1, "Python"), (1, "SQL"), (2, "SQL")]
    e = t["experiences"].orderBy("id").collect()
    assert (e[0]["company"], e[0]["end_date"], e[0]["technologies"], len(e[0]["embedding"])) == ("t", None, ["a", None], 4) and t["informations"].first()["location"] is None
    again = seeding.seed(spark, files, models.HashEmbedder(4), made.new_vectors)
    assert made.new_vectors.count() == 5 and again.new_vectors.count() == 0
    seeding.load(again, out)
    assert spark.read.parquet(f"{out}/projects").where("experience_id = 1").count() == 2


def test_files_settings_and_sinks(spark, tmp_path):
    (tmp_path / "u.json").write_bytes('[{"nom": "é"}]'.encode())
    (tmp_path / "w.json").write_bytes('[{"nom": "é"}]'.encode("latin-1"))
    (tmp_path / "b.json").write_bytes(b'[{"nom": "a\xff"}]')
    read = lambda n, e=None: ingest.load_json(spark, str(tmp_path / n), schemas.INFORMATIONS_JSON, e).first()["nom"]
    assert read("u.json") == read("w.json") == "é" and read("b.json", "UTF-8") == "a\ufffd"
    (tmp_path / ".env").write_text("# x\nTOP_K=7\nthreshold = 0.5\nOTHER=1\n")
    got = answering.Settings.from_env(str(tmp_path / ".env"), {"QUOTA": "9"})
    assert (got.top_k, got.threshold, got.quota, got.cooldown_ms) == (7, 0.5, 9, 30)
    for k in range(2):
        merge.append(spark.createDataFrame([(k, "u", "x")], "query_id int, query_text string, extra string"), str(tmp_path / "log"), schemas.RETRIEVAL_LOGS)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and "extra" not in log.columns and log.where("llm_provider is null").count() == 2
    assert spark.range(3).select(text.new_id().alias("i")).where("length(i) = 36").count() == 3


def test_assets(spark, tmp_path):
    (tmp_path / "cv.pdf").write_bytes(b"x" * 3000)
    files = assets.read_files(spark, str(tmp_path / "*.pdf"))
    assert [(r["filename"], r["kb"]) for r in assets.first_file(files).collect()] == [("cv.pdf", 2)]
    pages = assets.render_pages(files, lambda data: [(data[:2], 10, 20), (data[:3], 10, 20)])
    assert assets.page(pages, 2).first()["image_data"] == b"xxx" and assets.page(pages, 3).count() == 0
    assets.store(files, lambda data: [(data[:2], 10, 20), (data[:3], 10, 20)], str(tmp_path / "cv"))
    assert [(r["id"], r["filename"]) for r in assets.first_file(spark.read.parquet(str(tmp_path / "cv/cv_files"))).collect()] == [(1, "cv.pdf")]
    assert sorted((r["id"], r["page_number"]) for r in spark.read.parquet(str(tmp_path / "cv/cv_pages")).collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("name", ["chat_sessions"])
def test_tables_can_be_created(spark, name):
    merge.create_table(spark, f"{name}_t", schemas.TABLES[name])
    assert spark.table(f"{name}_t").count() == 0
    spark.sql(f"insert into {name}_t (id) values (1)")
    for _ in range(2):
        merge.add_columns(spark, f"{name}_t", "rating int default 5; question_count int default 1")
    assert spark.table(f"{name}_t").first()["rating"] == 5
    spark.sql(f"drop table {name}_t")
