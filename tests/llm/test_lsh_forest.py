"""Near-duplicates against brute force over all pairs of sets."""

import random
import re

import numpy as np
import pytest

from sparkloom.llm import lsh_forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    low = {i: i for i in sets if i is not None}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(low)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if any(u and v and 100 * len(u & v) >= percent * len(u | v) for u in sets[a] for v in sets[b]):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return sorted(((i, len(shingles(t, k)), None if i is None else root(i)) for i, t in rows), key=str)


def run(spark, rows, k=3, percent=85, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, key int")
    out = lsh_forest.near_duplicates(df, words=k, percent=percent, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


def edited(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("options", [{}, {"region_docs": 24}, {"block_shingles": 500}])
def test_groups_equal_brute_force(spark, options):
    """Groups of near copies around the threshold, larger than a region in the second case, more than a block in the third."""
    rng, rows = random.Random(3), []
    for g, (size, most) in enumerate([(70, 8), (30, 3), (2, 1), (2, 4), (5, 2), (60, 1)]):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(180)]
        rows += [(0, edited(rng, base, rng.randrange(most + 1))) for _ in range(size)]
    rows += [(0, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 300)))) for _ in range(60)]
    rng.shuffle(rows)
    rows = [(i * 3 + 1, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows, **options) == brute(rows, 3, 85)


def test_template_of_many_distinct_texts(spark):
    """1,500 documents of one template, seven edits each, with planted pairs just above the threshold: regions far above region_docs lose no link."""
    rng = random.Random(12)
    base = [f"t{i}" for i in range(200)]
    rows = []
    while len(rows) < 1500:
        w = edited(rng, base, 7).split(" ")
        rows += [" ".join(w), edited(rng, w, 4)] if rng.random() < 0.1 else [" ".join(w)]
    rows = [(i, t) for i, t in enumerate(rows)]
    got, want = run(spark, rows, region_docs=64), brute_sets(rows, 3, 85)
    assert {c for _, _, c in got} == {c for _, _, c in want} and got == want


def brute_sets(rows, k, percent):
    """As brute, by counting shared shingles (for more rows)."""
    import numpy as np

    sets = [shingles(t, k) for _, t in rows]
    code = {g: j for j, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(code)), np.float32)
    for i, s in enumerate(sets):
        m[i, [code[g] for g in s]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    link = 100 * both >= percent * (n[:, None] + n - both)
    low = np.arange(len(rows))
    while True:
        nxt = np.where(link, low, len(rows)).min(axis=1)
        if (nxt == low).all():
            return sorted(((i, len(s), int(low[i])) for i, s in enumerate(sets)), key=str)
        low = nxt


def test_regions_are_divided_by_common_prefixes():
    import numpy as np

    rng = np.random.default_rng(3)
    label = np.unique(rng.integers(0, 3, (3000, 15)).astype(np.uint8), axis=0)
    label = np.vstack([label, np.full((500, 15), 7, np.uint8)])
    parts = lsh_forest.divided(label, 40)
    assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and parts[0][0] == 0 and parts[-1][1] == len(label)
    for a, b, depth in parts:
        assert b - a <= 40 and (label[a:b, :depth] == label[a, :depth]).all()
        if 0 < depth < 15:  # one value less would be too many
            assert (label[:, : depth - 1] == label[a, : depth - 1]).all(axis=1).sum() > 40
    assert len({d for _, _, d in parts}) > 2  # the depth adapts


def test_regions_across_partitions(spark):
    """Regions that the sorted order cuts at partition borders, small and large ones."""
    rng, rows = random.Random(21), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(120)]
        rows += [edited(rng, base, rng.randrange(4)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(rows)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for limit in (4096, 9):
            assert run(spark, rows, region_docs=limit) == brute(rows, 3, 85)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "x"), (8, "X"), (9, long), (10, long + " end"), (None, "one two"), (None, None), (11, "one two"), (11, "x"), (12, "é É"), (13, "É é")]
    assert run(spark, rows) == brute(rows, 3, 85)


def test_empty_table_and_many_copies(spark):
    assert run(spark, []) == []
    rows = [(i, "a b c d e f g") for i in range(500, 0, -1)] + [(0, "other words here")]
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_isolated_pairs_in_regions_too_large(spark):
    """Pairs just above the threshold among distinct texts of one template, 0.78 to each other, which hold regions together to depth 12 and more."""
    rng = random.Random(8)

    def changed(words, at):
        return [f"c{rng.randrange(10**9)}" if k in at else w for k, w in enumerate(words)]

    rows = []
    for k in range(170):
        w = changed([f"t{i}" for i in range(300)], rng.sample(range(3, 297, 3), 6))
        rows += [w, changed(w, rng.sample(range(4, 295, 3), 8))] if k < 130 else [w]  # 274 of 322 shingles: 0.851
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = brute(rows, 3, 85)
    assert sum(i != c for i, _, c in want) >= 130
    assert run(spark, rows, region_docs=16) == want


def test_regions_too_large_in_several_blocks_of_sets(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(200)]
    rows = [(i, edited(rng, base, rng.randrange(3, 14))) for i in range(120)]
    assert run(spark, rows, region_docs=16, block_shingles=600) == brute(rows, 3, 85)


def test_one_id_with_several_texts_of_its_own(spark):
    """Every text of an id keeps its set: near copies of each are found."""
    rnd = np.random.default_rng(8)
    rows = []
    for f in range(20):
        for text in range(2):
            w = [f"w{x}" for x in rnd.integers(0, 10**9, 120)]
            rows.append((f, " ".join(w)))
            w[60] = "other"
            rows.append((1000 + 2 * f + text, " ".join(w)))
    rows += [(500, "alone a b c"), (500, None), (501, ""), (None, rows[0][1])]
    got = sorted((tuple(r)[0], r["component_id"], r["kept"]) for r in F_near(spark, rows) if r["doc_id"] is not None)
    want = sorted([(i, i % 1000 if i < 500 else (i - 1000) // 2 if i >= 1000 else i, None) for i, _ in rows if i is not None])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(k == (i == c) for i, c, k in got)


def F_near(spark, rows):
    return lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
