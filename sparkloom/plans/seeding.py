"""The whole ingest: JSON files -> skills, texts, vectors through the cache, keys and links -> tables, swapped in at once (K4-K9)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import text as T
from sparkloom.models import Embedder, embed_cached, embed_texts
from sparkloom.operators import merge
from sparkloom.sources import ingest
from sparkloom.sources.cache import VectorCache


@dataclass(frozen=True)
class Seeded:
    """The tables to load, by name, and the vectors that were made for them."""

    tables: dict[str, DataFrame]
    new_vectors: DataFrame


def _stored(df: DataFrame, ddl: str) -> DataFrame:
    """texts as they are stored: empty ones null, without what is not ASCII."""
    kinds = dict(c.split(" ", 1) for c in ddl.split(", ") if c.endswith(" string"))
    return df.withColumns({c: T.ascii_only(F.col(c)) for c in kinds if c in df.columns})


def _dates(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")).cast("date") for c in names})


def _with_vectors(df: DataFrame, text: Column, cache: DataFrame, embedder: Embedder, embed: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    rows = df.withColumn("_text", text)
    vectors, fresh = embed_cached(rows, cache, "_text", embedder, embed)
    return rows.join(vectors.withColumn("embedding", T.vector_rounded(F.col("embedding"))), "_text", "left").drop("_text"), fresh


def read(spark: SparkSession, files: dict[str, str]) -> dict[str, DataFrame]:
    """The inputs named experiences, formations, informations and skills; missing ones are empty."""
    kinds = {"experiences": schemas.EXPERIENCES_JSON, "formations": schemas.FORMATIONS_JSON, "informations": schemas.INFORMATIONS_JSON}
    got = {k: ingest.load_json(spark, files.get(k, "/nonexistent"), ddl) for k, ddl in kinds.items()}
    got["experiences"] = merge.staged(ingest.numbered(got["experiences"]))
    got |= {k: merge.staged(ingest.numbered(got[k], "_n")) for k in ("formations", "informations")}
    got["skills"] = ingest.load_skills(spark, files.get("skills", "/nonexistent"))
    return got


def skills_of(inputs: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skills with ids, those of experiences, those of projects).

    Keys are unique first (A7: global skills, then those of experiences, then
    of projects), then names: of equal names the last one's category and level stand (K4).
    """
    seq = ["a", "b", "c"]
    at = lambda df, *cols: df.select(*[F.col(c).cast("long").alias(k) if c else F.lit(0).cast("long").alias(k) for c, k in zip(cols, seq, strict=True)], "raw")
    exp = inputs["experiences"]
    of_exp = exp.select("exp_idx", F.posexplode("skills").alias("i", "raw"))
    of_proj = ingest.child_projects(exp).select("exp_idx", "pos", F.posexplode("skills").alias("i", "raw"))
    rows = [ingest.skill_rows(at(df, *cols), "raw", seq) for df, cols in ((inputs["skills"], ("i", None, None)), (of_exp, ("exp_idx", "i", None)), (of_proj, ("exp_idx", "pos", "i")))]
    unique = ingest.unique_skills(rows, seq)
    stored = unique.withColumns({c: T.ascii_only(F.col(c)) for c in ("name", "category", "proficiency_level")}).where("name is not null")
    named = merge.latest(stored, ["name"], ["source_rank", *seq])
    skills = merge.surrogate_keys(named.select("name", "category", "proficiency_level"), ["name"])
    own = lambda df: df.withColumn("name", T.ascii_only(T.strip(F.col("name"))))
    return merge.staged(skills), own(rows[1]).withColumnRenamed("a", "experience_id"), own(rows[2])


def seed(spark: SparkSession, files: dict[str, str], embedder: Embedder, cache: DataFrame | None = None, use_cache: bool = True, exact_links: bool = True, embed: Callable[..., DataFrame] = embed_texts) -> Seeded:
    """The tables of one ingest, ids in the order of the files.

    Without use_cache every text is embedded again (K12). Links find a skill by
    its very name, or by its key without exact_links (T13). embed is embed_texts,
    or embed_paced for a service that is limited.
    """
    inputs = read(spark, files)
    known = cache if cache is not None and use_cache else spark.createDataFrame([], schemas.EMBEDDINGS_CACHE)
    skills, of_exp, of_proj = skills_of(inputs)
    exp, fresh_e = _with_vectors(inputs["experiences"], ingest.experience_text(), known, embedder, embed)
    proj, fresh_p = _with_vectors(ingest.child_projects(inputs["experiences"]), ingest.project_text(), known, embedder, embed)
    form, fresh_f = _with_vectors(inputs["formations"], ingest.formation_text(), known, embedder, embed)
    info, fresh_i = _with_vectors(inputs["informations"], ingest.information_text(), known, embedder, embed)
    proj = merge.staged(merge.surrogate_keys(proj, ["exp_idx", "pos"]))
    of_proj = of_proj.join(proj.select(F.col("exp_idx").cast("long").alias("a"), F.col("pos").cast("long").alias("b"), F.col("id").alias("project_id")), ["a", "b"])
    exp = exp.withColumnRenamed("exp_idx", "id").withColumn("technologies", T.blank_items_null(F.coalesce("technologies", F.array().cast("array<string>"))))
    tables = {
        "skills": (skills, schemas.SKILLS, ()),
        "informations": (info.withColumnRenamed("_n", "id"), schemas.INFORMATIONS, ("date_naissance",)),
        "experiences": (exp, schemas.EXPERIENCES, ("start_date", "end_date")),
        "formations": (form.withColumnRenamed("_n", "id"), schemas.FORMATIONS, ("start_date", "end_date")),
        "projects": (proj.withColumnRenamed("exp_idx", "experience_id"), schemas.PROJECTS, ("start_date", "end_date")),
        "experience_skills": (ingest.link_skills(of_exp, skills, "experience_id", exact=exact_links), schemas.EXPERIENCE_SKILLS, ()),
        "project_skills": (ingest.link_skills(of_proj, skills, "project_id", exact=exact_links), schemas.PROJECT_SKILLS, ()),
    }
    out = {}
    for name, (df, ddl, dates) in tables.items():
        df = _dates(_stored(df, ddl), *dates)
        now = {c: F.current_timestamp() for c in ("created_at", "updated_at") if f"{c} " in ddl}
        out[name] = df.withColumns(now).to(spark.createDataFrame([], ddl).schema)
    fresh = fresh_e.unionByName(fresh_p).unionByName(fresh_f).unionByName(fresh_i).dropDuplicates(["md5", "model"])
    return Seeded(out, fresh)


def load(seeded: Seeded, folder: str, cache: VectorCache | None = None) -> None:
    """K7-K9: all tables below the folder, written beside it and swapped at once: a failed ingest changes nothing.

    New vectors go to the cache first (S11), so a failed load does not pay for them again.
    """
    if cache is not None:
        cache.append(seeded.new_vectors)
    merge.replace_tables(seeded.tables, folder)
