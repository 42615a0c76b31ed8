"""The pipeline's stages against brute force, one after the other on sf0.001."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_lsh_forest import brute as near_brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def bad_quality(t):
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    chars = sum(map(len, w))
    return not w or 100 * len(hit) > 50 * len(w) or 100 * len(re.findall(r"[#*$%&|<>]", t or "")) > 25 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or not 2 * len(w) <= chars <= 15 * len(w)


def without_repeats(rows, k=20):
    """rows (doc_id, text) in order -> doc_id -> the text left (None: nothing left)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w, gone = words(t), set()
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            if g in seen:
                gone |= set(range(s, s + k))
            seen.add(g)
        out[i] = (" ".join(x for p, x in enumerate(w) if p not in gone) if gone else t) if len(gone) < len(w) or not w else None
    return out


@pytest.fixture(scope="module")
def stages(spark, sf):
    from sparkloom.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in P.STAGES:
        docs = written(f(spark, docs, sf), name.replace(" ", "-"))
        out.append(docs)
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay_those_of_documents(stages):
    assert [n for n, _ in P.STAGES] == ["quality rules", "near duplicates", "substring dedup", "mixing", "packing"]
    for s in stages[1:5]:
        assert s.columns == stages[0].columns and s.dtypes == stages[0].dtypes


def test_quality_rules(stages):
    assert sorted(pairs(stages[1])) == sorted((i, t) for i, t in pairs(stages[0]) if not bad_quality(t))


def test_near_duplicates(stages):
    keep = {i for i, _, c in near_brute(pairs(stages[1]), 5, 80) if i == c}
    assert sorted(pairs(stages[2])) == sorted((i, t) for i, t in pairs(stages[1]) if i in keep)


def test_substring_dedup(stages):
    want = {i: t for i, t in without_repeats(pairs(stages[2])).items() if t is not None}
    assert dict(pairs(stages[3])) == want
    assert stages[3].where(F.length("text") > F.col("n_chars")).count() == 0


def test_mixing(stages):
    before, after = pairs(stages[3]), Counter(i for i, _ in pairs(stages[4]))
    source = {r["doc_id"]: r["source"] for r in stages[3].collect()}
    assert set(after) <= set(source) and max(after.values()) <= 3
    size, taken = defaultdict(int), defaultdict(int)
    for i, t in before:
        size[source[i]] += len(words(t))
        taken[source[i]] += len(words(t)) * after[i]
    targets = fill(size)
    longest = max(len(words(t)) for _, t in before)
    assert all(abs(taken[s] - targets[s]) <= longest for s in size)


def fill(size):
    """Targets by repeated resharing of what caps cut off."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    done, left, total = {}, set(size), sum(size.values())
    while True:
        level = (total - sum(done.values())) / max(1e-12, sum(weight[s] for s in left)) if left else 0
        over = {s for s in left if level * weight[s] > 3 * size[s]}
        if not over:
            return done | {s: level * weight[s] for s in left}
        done |= {s: 3.0 * size[s] for s in over}
        left -= over


def test_packing(stages):
    docs = Counter(i for i, _ in pairs(stages[4]))
    rows = stages[5].collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 2048
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == docs
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


LONG = " ".join(f"w{i} of {i * 7 % 11}" for i in range(3000))
OTHER = " ".join(f"v{i}" for i in range(80))
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", None, 5), (3, LONG, "en", None, 5), (None, LONG + " x", "en", "a", 1), (4, "short text", "en", "a", 5), (5, OTHER, "en", "a", 9), (5, OTHER + " and more", "de", "b", 9), (None, None, None, None, None)]


def edge_docs(spark, rows=EDGE):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("kept", F.lit(False))


def test_edge_rows(spark, sf):
    stage = dict(P.STAGES)
    docs = edge_docs(spark)
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(stage["quality rules"](spark, docs, sf).collect()) == key(r for r in EDGE if r[1])
    seen = set()
    for order in (docs, docs.orderBy(F.desc("n_chars"), F.desc("text")).coalesce(1)):  # one of each id, the same one in any order
        got = stage["near duplicates"](spark, order, sf).collect()
        assert key(r for r in got if r["doc_id"] != 5) == key([*EDGE[:3], EDGE[4], EDGE[5], EDGE[8]])
        five = [tuple(r) for r in got if r["doc_id"] == 5]
        assert len(five) == 1 and five[0] in EDGE
        seen.add(five[0])
    assert len(seen) == 1
    got = stage["substring dedup"](spark, docs, sf).collect()
    assert key((r["doc_id"], r["text"]) for r in got) == key([(1, None), (2, ""), (3, LONG), (3, LONG), (None, "x"), (4, "short text"), (5, OTHER), (5, OTHER + " and more"), (None, None)])
    assert {r["n_chars"] for r in got if r["text"] == "x"} == {1}
    mixed = stage["mixing"](spark, docs, sf)
    assert mixed.columns == list(P.COLUMNS) and {tuple(r) for r in mixed.collect()} <= set(EDGE)
    assert max(Counter(map(tuple, mixed.collect())).values()) <= 6  # two equal rows, three times each
    pieces = stage["packing"](spark, docs, sf).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r[0] for r in EDGE)
    assert all(r["length"] == 1 for r in pieces if r["doc_id"] in (1, 2))


def test_empty_tables(spark, sf):
    docs = edge_docs(spark).limit(0)
    for _, f in P.STAGES:
        docs = f(spark, docs, sf)
        assert docs.count() == 0
