"""The rule ledger against plain Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm import quality_rules as Q, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(hit)


def bits(n, chars, sym, lines, dup, rep):
    return (n < 50) | (100 * rep > 50 * n) << 1 | (100 * sym > 25 * n) << 2 | (2 * dup > lines) << 3 | (chars < 2 * n or chars > 15 * n) << 4 | (n == 0) << 5


EDGE = [None, "", " \n\t", "a b c a b c", "a b c", "a a a a", "x\ny\nx\n\n \nx", "# $ | <é漢🙂>", "one two three\x0bfour\x0cfive\r\nsix", "w " * 20_000, " ".join(f"v{i}" for i in range(20_000)), "a b c d", "a\x1cb c"]


def test_measures(spark, sf):
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + EDGE + EDGE[:5]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("fail_bits", F.lit("clash"))
    got = {r["doc_id"]: (tuple(r[m] for m in Q.MEASURES), r["fail_bits"]) for r in Q.ledger(df).collect()}
    for i, t in enumerate(docs):
        m = measures(t)
        assert got[i] == (m, bits(*m)), (i, t and t[:80])


def test_policies_and_ablations(spark, sf):
    led = Q.ledger(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).cache()
    mask = [r["fail_bits"] for r in led.collect()]
    for version, names in Q.POLICIES.items():
        m = Q.mask_of(names)
        kept = Q.apply_policy(led, version).where("kept").count()
        assert kept == sum(b & m == 0 for b in mask)
        rows = {r["rule"]: r for r in Q.ablations(led, version).collect()}
        assert set(rows) == set(names)
        for k, rule in enumerate(Q.RULES):
            if rule.name in names:
                r = rows[rule.name]
                assert (r["n_failed"], r["n_only"], r["n_rejected"]) == (sum(b >> k & 1 for b in mask), sum(b & m == 1 << k for b in mask), sum(b & m != 0 for b in mask))
    assert Q.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_is_native_and_follows_the_base(spark, sf):
    out = queries.op8_quality_rules(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert out.where("kept and base_failed").count() == 0
    assert out.where("base_failed <> (n_words < 50 or 100 * n_repeat_words > 50 * n_words)").count() == 0


def test_ablation_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.SQL["rule_ablations"])
    got = queries.rule_ablations(spark, sf)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.fetchall()) and got.count() == 5
