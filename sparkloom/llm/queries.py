"""The registered queries opN_<name> of the operators, with SQL where it can express them.

Each query applies its operator, with production parameters, to its whole
table and derives the contract's columns from the operator's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import (
    conversation_repair, cotraining, debruijn, filter_audit, lsh_forest, mixing, packing, ppm, pq_dedup, quality_rules, range_coder, token_counts, warc_bundles, word_bpe,
)
from sparkloom.llm.common import documents, n_words_of, written


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", n_words_of(F.col("text")).alias("size"))
    plan = mixing.mix_plan(docs, weights=(5.0, 2.0, 1.0), max_repeat=3.0)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc_bundles.write_bundles(pages, warc_bundles.bundle_dir(spark))
    return warc_bundles.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last_id FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM g
"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(m.b, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score(documents(spark, sf_dir), ~ppm.held_out(F.col("doc_id")), depth=5)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = debruijn.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM k),
c AS (SELECT DISTINCT doc_id, i + x AS i FROM (SELECT doc_id, i, unnest(range(20)) AS x FROM g WHERE r > 1)),
m AS (SELECT d.doc_id, u.i, w[u.i] AS word, c.i IS NOT NULL AS gone
  FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) u LEFT JOIN c ON c.doc_id = d.doc_id AND c.i = u.i),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(documents(spark, sf_dir), capacity=2048, tokenizer="byte_bpe_50k.json", end_id=0)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048, gap="gap")


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)),
u AS (SELECT * FROM v WHERE isfinite(n) AND n > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(m.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    led = quality_rules.apply_policy(quality_rules.apply_policy(led, "base", "_base"), "v1", "kept")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "fail_bits")


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
k AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM k),
c AS (SELECT r, count(DISTINCT i + x)::BIGINT AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS x FROM g WHERE c > 1) GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (r)),
f AS (
  SELECT *, ((n_words < 50)::BIGINT | ((100 * n_repeat_words > 50 * n_words)::BIGINT << 1) | ((100 * n_symbols > 25 * n_words)::BIGINT << 2)
    | ((2 * n_dup_lines > n_lines)::BIGINT << 3) | ((word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT << 4)
    | ((n_words = 0)::BIGINT << 5)) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 31) = 0 AS kept, fail_bits
FROM f
"""


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op8's policy decides, from the ledger alone."""
    return quality_rules.ablations(written(quality_rules.ledger(documents(spark, sf_dir).select("doc_id", "text")).select("fail_bits"), "ledger"), "v1")


ABLATIONS_SQL = f"""
WITH b AS (SELECT fail_bits & 31 AS b FROM ({OP8_SQL})),
r(rule, bit) AS (VALUES ('too_few_words', 1::BIGINT), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('word_length', 16))
SELECT rule, 'v1' AS policy, count(*) FILTER (b & bit <> 0) AS n_failed, count(*) FILTER (b = bit) AS n_only, count(*) FILTER (b <> 0) AS n_rejected
FROM b, r GROUP BY rule
"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trained = cotraining.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = cotraining.score_views(trained.views, trained.heads)
    return scored.select("*", ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("kept"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, tokenizer="byte_bpe_50k.json")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = written(word_bpe.encode_documents(documents(spark, sf_dir), tokenizer="word_bpe_49k.json", end_id=1), "token-ids")
    out = range_coder.id_dir(spark)
    return range_coder.read_ids(range_coder.write_ids(ids, out), out, with_ids=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.mask_counts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_audit.audit(written(counts, "masks"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN e USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, x.i, y.i, z.i] AS o FROM f a, f b, f x, f y, f z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5),
s AS (
  SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step.i AS step, o[step.i] AS k, n, good, toxic, fails,
    list_bool_or(list_transform(o[1:step.i - 1], lambda k: fails[k])) IS TRUE AS gone
  FROM c, o, f step),
r AS (
  SELECT part, filter_order, step::INT AS step, substr('ABCDE', k, 1) AS filter,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails[k]), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails[k]), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails[k]), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails[k] AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails[k]), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails[k]), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair(conversation_repair.damage(turns)).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    none = {x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    text = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return every.join(found, every["conv_id"].eqNullSafe(found["c"]), "left").select("conv_id", *none.values(), *text)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_warc_bundles, op3_near_duplicates, op4_lm_scores, op5_substring_dedup, op6_pack_sequences, op7_embedding_duplicates, op8_quality_rules, op9_quality_classifier, op10_token_counts, op11_token_files, op12_filter_audit, op13_conversation_repair, rule_ablations)}
SQL = {"op2_warc_bundles": OP2_SQL, "op3_near_duplicates": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op7_embedding_duplicates": OP7_SQL, "op8_quality_rules": OP8_SQL, "op12_filter_audit": OP12_SQL, "rule_ablations": ABLATIONS_SQL}
