"""Ingest of nested JSON records: read, normalise, de-duplicate, assemble text, load."""

from __future__ import annotations

import codecs
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import merge


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file (of a folder's first file), read as a stream; none where there is no file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s for s in fs.globStatus(at) or []), key=lambda s: s.getPath().toString())
    if found and found[0].isDirectory():
        found = sorted((s for s in fs.listStatus(found[0].getPath()) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda s: s.getPath().toString())
    if not found:
        return b""
    stream = fs.open(found[0].getPath())
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n), "ISO-8859-1").encode("latin-1")
    finally:
        stream.close()


def sniff_encoding(spark: SparkSession, path: str, head: int = 10_000) -> str:
    """The encoding of a file by its first bytes: a byte order mark, else UTF-8 where they are valid, else Latin-1."""
    data = _head(spark, path, head)
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if data.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data)  # a character may be cut at the end
    except UnicodeDecodeError:
        return "ISO-8859-1"
    return "UTF-8"


def load_json(spark: SparkSession, path: str, schema: str, encoding: str | None = None) -> DataFrame:
    """A JSON array as rows; a missing file is an empty table.

    Without an encoding the file's first bytes tell it; bytes that do not
    decode are replaced.
    """
    try:
        return spark.read.schema(schema).option("multiLine", True).option("encoding", encoding or sniff_encoding(spark, path)).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _line(*parts: Column | str, none: str = "") -> Column:
    """Text and values one after the other; a null value shows as `none`."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(none)) for p in parts])


def _paragraph(parts: list[Column], default: str) -> Column:
    return T.falsy_default(T.join_parts(parts), default)


# The labels, the order and the defaults of the four texts that are embedded.
# Fields that have no default of their own show a null as `none`; all others as nothing.


def information_text(year: str | Column = "2015", none: str = "None") -> Column:
    """what a person says of themselves; year is that of the arrival."""
    c = F.col
    parts = [
        F.concat(_line("Je suis ", c("prenom"), " ", c("nom")), _line(", avec mon prénom qui se prononce ", c("prononciation"), " ", none=none)),
        _line("Je suis née à ", c("pays_naissance"), " le ", c("date_naissance"), none=none),
        F.concat(_line("Je suis arrivé en ", c("location"), none=none), _line(" en ", year)),
        _line("En plus de ma grande passion pour l'informatique, je suis également ", c("passion"), none=none),
    ]
    return _paragraph(parts, "Informations sociales")


def experience_text(none: str = "None") -> Column:
    """With the goal, problem, solution, results and impact of the first project, if there is one."""
    c, first = F.col, F.get(F.col("projects"), 0)
    parts = [
        _line("Date : ", c("start_date"), " à ", c("end_date")),
        F.concat(_line("Entreprise : ", c("company")), _line(", ", c("location"), none=none)),
        _line("Rôle : ", c("role")),
        _line("Type : ", c("mission_type")),
        c("context"),
        *[first[k] for k in ("objective", "problem", "solution", "results", "impact")],
        _line("Technologies : ", T.array_text(c("technologies"))),
    ]
    return _paragraph(parts, "Expérience professionnelle")


def project_text() -> Column:
    """F4."""
    c = F.col
    labels = (("Objectif", "objective"), ("Problème", "problem"), ("Solution", "solution"), ("Résultats", "results"), ("Impact", "impact"), ("Stack", "stack"))
    parts = [_line("Projet : ", c("name")), _line("Date : ", c("start_date"), " à ", c("end_date")), c("description"), *[_line(f"{label} : ", c(k)) for label, k in labels]]
    return _paragraph(parts, "Projet")


def formation_text() -> Column:
    """F4."""
    c = F.col
    parts = [
        _line(c("degree"), " à ", c("institution")),
        _line("Date : ", c("start_date"), " à ", c("end_date")),
        _line("Domaine : ", c("field")),
        c("description"),
        _line("Apprentissages clés : ", c("key_learnings")),
    ]
    return _paragraph(parts, "Formation")


def numbered(df: DataFrame, out: str = "exp_idx") -> DataFrame:
    """The place of each record: consecutive numbers in the order of the files' rows."""
    return merge.surrogate_keys(df.withColumn("_m", F.monotonically_increasing_id()), ["_m"], out).drop("_m")


def child_projects(experiences: DataFrame) -> DataFrame:
    """Projects with their parent's ordinal and their own place."""
    return experiences.select("exp_idx", F.posexplode("projects").alias("pos", "p")).select("exp_idx", "pos", "p.*")


def load_skills(spark: SparkSession, path: str) -> DataFrame:
    """(i, raw): the items of a JSON array that mixes names and objects, as raw JSON in their order."""
    try:
        whole = spark.read.option("wholetext", True).text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "i int, raw string")
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("i", "raw"))


def skill_rows(items: DataFrame, raw: str, seq: list[str], bare_category: str = "Programmation") -> DataFrame:
    """Skills from raw JSON: an object gives name, category and level, a bare string its name."""
    o = F.from_json(F.col(raw), "name string, category string, proficiency_level string")
    is_object = F.col(raw).startswith("{")
    bare = F.regexp_replace(F.col(raw), '^"|"$', "")
    return items.select(*seq, F.when(is_object, o["name"]).otherwise(bare).alias("name"), F.when(is_object, o["category"]).otherwise(F.lit(bare_category)).alias("category"), F.when(is_object, o["proficiency_level"]).alias("proficiency_level"))


def unique_skills(sources: list[DataFrame], seq: list[str]) -> DataFrame:
    """Of equal keys the first wins, sources in their order; blank names go."""
    ranked = [s.withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, ranked).where(F.col("name").isNotNull() & (T.strip(F.col("name")) != ""))
    keys = T.skill_key(F.col("name"), F.col("category"), F.col("proficiency_level"))
    rows = rows.withColumns({f"k{i}": k for i, k in enumerate(keys)})
    w = Window.partitionBy("k0", "k1", "k2").orderBy("source_rank", *seq)
    first = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return first.select(T.strip(F.col("name")).alias("name"), F.col("k1").alias("category"), F.col("k2").alias("proficiency_level"), F.col("k0").alias("key"), "source_rank", *seq)


def link_skills(owners: DataFrame, skills: DataFrame, owner: str, exact: bool = False) -> DataFrame:
    """(owner, skill id) without repeats. Names link by their
    normalised key, or by exact case on request (then other spellings lose their link)."""
    key = (lambda c: F.col(c)) if exact else (lambda c: F.lower(T.strip(F.col(c))))
    s = skills.select(key("name").alias("_k"), F.col("id").alias("skill_id"))
    return owners.withColumn("_k", key("name")).join(s, "_k").select(owner, "skill_id").distinct()
