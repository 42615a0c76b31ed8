"""The corpus pipeline: five stages over `documents`, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents;
the last returns one row a packed piece. Further columns of docs are dropped,
whatever their names; an empty table gives an empty result at every stage.
Mixing draws documents and packing places them, which SQL cannot express, so
ORACLE_SQL is None and the stages are tested against brute force.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import debruijn, lsh_forest, mixing, packing, quality_rules
from sparkloom.llm.common import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 of the rule ledger keeps.

    It rejects repeated windows and lines, symbols in place of words, words of
    odd length and texts without words (null and blank ones); short texts stay.
    Rows are judged each for itself, so repeats and null ids stay or go alike.
    """
    # the ledger is stored: a filter on its bits would otherwise be pushed through every measurement
    led = written(quality_rules.ledger(docs.select(*COLUMNS)), "ledger")
    return quality_rules.apply_policy(led, "v2", "kept").where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Texts without words and rows without an id are in no group and stay. Of
    rows that share an id one stays: the smallest by the hash of all columns,
    then by the columns themselves, whatever the order of the rows.
    """
    docs = docs.select(*COLUMNS)
    found = lsh_forest.near_duplicates(docs, words=5, percent=80)
    left = docs.join(written(found.where("not kept").select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*COLUMNS)
    repeated = left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return left
    ids = written(repeated.select("doc_id"), "repeated")
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = left.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(*COLUMNS).alias("h"), *rest)).alias("r"))
    return left.join(ids, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select("doc_id", *[F.col(f"r.{c}") for c in rest]).select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier passage of 20 words or more covers; what is left empty goes.

    Of a changed text n_chars is counted anew; all others keep text and
    n_chars as they are. Texts without words stay; null ids come after all
    others; rows that share an id count as one place.
    """
    out = debruijn.remove_repeats(docs.select(*COLUMNS), words=20).where("n_removed < n_words or n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
    return out.select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources (weights 5, 2, 1 in turn, three times at most) takes them.

    A null source is a source of its own, the last; texts without words are
    drawn by number of documents alone; rows of equal id, source and size
    share their copies; ties are settled by hashes, so reruns agree.
    """
    return mixing.mix(docs.select(*COLUMNS), weights=(5.0, 2.0, 1.0), max_repeat=3.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of 2048 tokens and its place there.

    A null text packs as its end token alone, a repeated row once for each of
    its rows; rows without an id are packed like others.
    """
    pieces = packing.pieces_of(docs, capacity=2048, tokenizer="byte_bpe_50k.json", end_id=0)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("substring dedup", repeated_passages), ("mixing", mixture), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
