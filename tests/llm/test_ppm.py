"""Prediction by partial matching against a plain dictionary version."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ppm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DEPTH = 3


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def coded(t):
    return (" ".join(WORD.findall(lower(t))) + "\n").encode()


def brute(rows, depth):
    """rows: (text, trained) -> (n_tokens, n_known, base, score) each."""
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    words = Counter()
    for text, trained in rows:
        if trained:
            words.update([*WORD.findall(lower(text)), None])
            b = b"\n" * depth + coded(text)
            for i in range(depth, len(b)):
                counts[depth][b[i - depth : i]][b[i]] += 1
    for k in range(depth - 1, -1, -1):
        for ctx, syms in counts[k + 1].items():
            for s in syms:
                counts[k][ctx[1:]][s] += 1
    total, distinct = sum(words.values()), len(words)
    out = []
    for text, _ in rows:
        b, score = b"\n" * depth + coded(text), 0.0
        for i in range(depth, len(b)):
            gone = set()
            for k in range(depth, -1, -1):
                syms = {s: c for s, c in counts[k].get(b[i - k : i], {}).items() if s not in gone}
                if not syms:
                    continue
                t = 2 * sum(syms.values())
                if b[i] in syms:
                    score += math.log10((2 * syms[b[i]] - 1) / t)
                    break
                score += math.log10(len(syms) / t)
                gone |= set(syms)
            else:
                score -= math.log10(256 - len(gone))
        toks = [*WORD.findall(lower(text)), None]
        out.append((len(toks), sum(w in words for w in toks), sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in toks), score))
    return out


def check(spark, rows, depth=DEPTH):
    df = spark.createDataFrame([(i, t, tr, "x") for i, (t, tr) in enumerate(rows)], "doc_id long, text string, tr boolean, block string")
    got = {r["doc_id"]: r for r in ppm.score(df, F.col("tr"), depth=depth).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(brute(rows, depth)):
        r = got[i]
        assert (r["n_tokens"], r["n_known"]) == want[:2]
        assert r["base_score"] == pytest.approx(want[2], rel=1e-9)
        assert r["score"] == pytest.approx(want[3], rel=1e-9)


def test_edge_texts(spark):
    check(spark, [("The cat sat on the mat", True), ("the hat sat\n\non a cat", True), (None, True), ("", False), (" \t\n", False), ("Zebra éß 漢字 cat the", False), ("The cat sat on the mat", False), ("x" * 5000, True), ("the " * 3000, False)])


def test_without_training_rows(spark):
    check(spark, [("a b", False), (None, False)])


def test_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    data = [(r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in rows[:120]]
    check(spark, data)


def test_empty_table_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c")], "doc_id long, text string")
    out = ppm.score(df, ~ppm.held_out(F.col("doc_id"))).collect()
    assert len(out) == 3 and len({r["score"] for r in out}) == 1
    assert ppm.score(df.limit(0), F.lit(True)).count() == 0


def test_query_equals_brute_force_over_the_whole_table(spark, sf):
    """The registered query at its own depth of 5."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    trained = [zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for r in docs]
    out = queries.op4_lm_scores(spark, sf)
    assert out.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(docs) and len({r["train_tokens"] for r in got.values()}) == 1
    for d, t, want in zip(docs, trained, brute([(d["text"], t) for d, t in zip(docs, trained, strict=True)], 5), strict=True):
        r = got[d["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (not t, *want[:2])
        assert r["base_score"] == pytest.approx(want[2], rel=1e-9) and r["score"] == pytest.approx(want[3], rel=1e-9)
