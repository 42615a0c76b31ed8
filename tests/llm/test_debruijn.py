"""Substring de-duplication against a plain set of windows."""

import hashlib
import random
import re

import pytest

from sparkloom.llm import debruijn, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """rows (doc_id, text) -> doc_id -> (n_words, n_removed, kept text)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w, gone = WORD.findall(t or ""), set()
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            if g in seen:
                gone |= set(range(s, s + k))
            seen.add(g)
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def run(spark, rows, k):
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, n_words int, block string")
    out = debruijn.remove_repeats(df, words=k)
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()}


@pytest.mark.parametrize("k", [3, 8, 20])
def test_random_texts_with_shared_passages(spark, k):
    rng = random.Random(k)
    passages = [[f"p{j}_{rng.randrange(50)}" for _ in range(rng.choice([k - 1, k, k + 1, 5 * k]))] for j in range(6)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [f"r{rng.randrange(30)}" for _ in range(rng.randrange(40))]
        rows.append((i, rng.choice([" ", "\n", "\t \n"]).join(w)))
    rng.shuffle(rows)
    assert run(spark, rows, k) == brute(rows, k)


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 500), (5, "a " * 19), (6, long), (7, long), (8, "Ab " * 30), (9, "é漢 " * 25), (-5, "a " * 30)]
    assert run(spark, rows, 20) == brute(rows, 20)
    assert run(spark, [], 20) == {}
    df = spark.createDataFrame([(None, "b " * 30), (None, "c " * 30), (1, "c " * 30), (2, "z z"), (2, "z z")], "doc_id long, text string")
    got = sorted((r["n_words"], r["n_removed"]) for r in debruijn.remove_repeats(df, words=20).collect())
    assert got == [(2, 0), (2, 0), (30, 29), (30, 29), (30, 30)]


def test_one_passage_in_more_blocks_than_a_task_holds_at_once(spark, monkeypatch):
    """Hot k-mers that come in parts go by one source; lots of blocks are small."""
    monkeypatch.setattr(debruijn, "block_count", lambda *_: 60)
    monkeypatch.setattr(debruijn, "LOT", 7)
    whole = debruijn._repeated
    monkeypatch.setattr(debruijn, "_repeated", lambda e: whole(e, 5))
    rng = random.Random(5)
    hot = [f"h{j}" for j in range(30)]
    rows = [(i, " ".join([f"a{rng.randrange(9)}" for _ in range(rng.randrange(6))] + hot + [f"b{i}"] * rng.randrange(9))) for i in range(120)]
    assert run(spark, rows, 8) == brute(rows, 8)


def test_nodes_with_several_edges_end_paths(spark):
    """Passages that fork and join at shared words."""
    rng = random.Random(6)
    piece = [[f"q{j}_{x}" for x in range(12)] for j in range(5)]
    rows = [(i, " ".join(w for _ in range(6) for w in rng.choice(piece))) for i in range(80)]
    assert run(spark, rows, 5) == brute(rows, 5)
    assert run(spark, rows, 1) == brute(rows, 1)


def test_half_the_ids_are_null(spark):
    """Texts without an id spread over blocks; each comes after all texts with one."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(None if i % 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    with_ids = brute([(i, t) for i, t in enumerate(texts) if i % 2 == 0], 6)
    got = debruijn.remove_repeats(df, words=6)
    assert got.where("doc_id is null").count() == 30
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got.where("doc_id is not null").collect()} == with_ids


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, r, hashlib.sha256(t.encode()).hexdigest()) for i, (n, r, t) in brute(rows, 20).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op5_substring_dedup(spark, sf).collect()}
    assert got == want
