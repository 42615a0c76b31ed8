"""Packing: pieces against the tokenizers library, bins against bounds and exact optima."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import packing, queries


def used(patterns):
    c = Counter()
    for times, bins in patterns:
        for s, k in bins:
            c[s] += times * k
    return c


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_bin_completion_is_a_packing_and_near_the_bound(sizes):
    counts = Counter(sizes)
    found = packing.bin_completion(dict(counts), 30, nodes=300)
    p = found.patterns
    assert used(p) == counts and all(sum(s * k for s, k in bins) <= 30 for _, bins in p)
    n = sum(t for t, _ in p)
    assert found.bins == n and found.bound == packing.waste_bound(dict(counts), 30) <= n <= sum(t for t, _ in packing.best_fit(dict(counts), 30))


def optimum(sizes, cap):
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            if all(sum(s for s, w in zip(sizes, where, strict=True) if w == b) <= cap for b in range(n)):
                return n
    return 0


def test_small_cases_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(25):
        sizes = rng.integers(1, 20, 6).tolist()
        best = optimum(sizes, 20)
        assert packing.bin_completion(dict(Counter(sizes)), 20).bins == best >= packing.waste_bound(dict(Counter(sizes)), 20)


def full_bins(rng, bins, per, cap=2048):
    """Lengths that fill `bins` bins of `per` pieces without waste."""
    cuts = [np.sort(rng.choice(np.arange(1, cap), per - 1, replace=False)) for _ in range(bins)]
    return Counter(x for c in cuts for x in np.diff([0, *c, cap]).tolist())


@pytest.mark.parametrize("per", [3, 4, 8, 12])
@pytest.mark.parametrize("bins", [20, 60])
def test_search_meets_known_optima_that_best_fit_misses(per, bins):
    counts = full_bins(np.random.default_rng(bins + per), bins, per)
    s = packing.bin_completion(dict(counts), 2048)
    assert used(s.patterns) == counts and s.bound == bins and s.visited > 0
    assert sum(t for t, _ in packing.best_fit(dict(counts), 2048)) == bins + 1
    assert s.bins == bins if (per, bins) != (3, 60) else s.bins - s.bound <= 1  # the one that the nodes do not reach


def test_many_small_pieces_and_node_limit():
    counts = Counter(np.random.default_rng(5).integers(180, 201, 500).tolist())
    s = packing.bin_completion(dict(counts), 2048)
    assert s.bins < sum(t for t, _ in packing.best_fit(dict(counts), 2048)) and s.bins - s.bound <= 1
    assert packing.bin_completion(dict(counts), 2048, nodes=3).visited == 3
    assert packing.bin_completion({}, 2048) == packing.Solution([], 0, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 25))
def test_completions_are_all_the_maximal_multisets(counts, room):
    sizes = sorted(counts)
    want = set()
    for n in itertools.product(*[range(counts[s] + 1) for s in sizes]):
        left = room - sum(a * s for a, s in zip(n, sizes, strict=True))
        if left >= 0 and not any(s <= left and a < counts[s] for a, s in zip(n, sizes, strict=True)):
            want.add(tuple(s for a, s in zip(reversed(n), reversed(sizes), strict=True) for _ in range(a)))
    got = list(packing.completions(counts, room))
    assert set(got) == want and len(got) == len(want)
    assert [sum(x) for x in got] == sorted((sum(x) for x in got), reverse=True)


def test_search_packs_rows_that_best_fit_does_not(spark):
    """Through Spark: a table whose optimum needs the search, half its ids null, with and without a broadcast of slots."""
    counts = full_bins(np.random.default_rng(20), 20, 8)
    rows = [(None if k % 2 else k, 0, int(s)) for k, s in enumerate(counts.elements())]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    for slots in (250_000, 0):
        got = packing.pack(df, broadcast_slots=slots).collect()
        assert len({r["sequence_id"] for r in got}) == 20 and Counter(r["length"] for r in got) == counts
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert all([o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] for b in bins.values())


def check(rows, texts, capacity=2048):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        ps = sorted(by_doc.pop(i), key=lambda r: r["piece"])
        assert [r["piece"] for r in ps] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in ps:
            assert r["start"] == at and r["length"] == (capacity if r["piece"] else len(ids) - (len(ps) - 1) * capacity)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= capacity
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= 1.01 * total / capacity + 1


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries.op6_pack_sequences(spark, sf).collect(), texts)


def test_defined_cases(spark):
    from pyspark.sql import functions as F

    texts = {1: None, 2: "", 3: "word " * 9000, 4: "<|endoftext|> x", 5: "é漢字🙂", 6: "x" * 50_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("clash"))
    pieces = packing.pieces_of(df).withColumn("ids_crc32", F.crc32("ids"))
    packed = packing.pack(pieces)
    check(packed.collect(), texts)
    seqs = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and r["n_tokens"] <= 2048 for r in seqs)
    assert packing.pack(packing.pieces_of(df.limit(0))).count() == 0
    twice = packing.pack(packing.pieces_of(df.unionByName(df)).drop("ids"))
    assert twice.count() == 2 * packed.count()
    with pytest.raises(ValueError):
        packing.pack(pieces, capacity=100).count()


def test_widening_search_is_complete():
    """With one filling a node at first, all small problems are still solved to their optimum."""
    rnd = random.Random(4)
    for _ in range(60):
        sizes = [rnd.randrange(2, 20) for _ in range(rnd.randrange(4, 10))]
        counts = {s: sizes.count(s) for s in sizes}
        got = packing.bin_completion(counts, 20, nodes=10**6, width=1, look=1)
        assert got.bins == fewest(tuple(sorted(sizes, reverse=True)), 20), sizes


def fewest(sizes, cap):
    """The least number of bins, by trying every place for every piece."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, (*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]))
        place(i + 1, (*rooms, cap - sizes[i]))

    place(0, ())
    return best
