"""Embedding near-duplicates against brute-force cosines."""

import math

import numpy as np
import pytest

from sparkloom.llm import pq_dedup, queries

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string"


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.95):
    """vec_id -> (n_links, component); vectors of different lengths never link."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and usable(v)]
    dim = max((len(rows[k][1]) for k in ok), default=1)
    x = np.zeros((len(ok), dim))
    size = np.array([len(rows[k][1]) for k in ok])
    for at, k in enumerate(ok):
        x[at, : size[at]] = np.array(rows[k][1], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= cosine) & (size[:, None] == size)
    np.fill_diagonal(link, False)
    ids = np.array([rows[k][0] for k in ok])
    low = ids.copy()
    while True:
        nxt = low.copy()
        for k in range(len(ids)):
            nxt[k] = min(low[k], low[link[k]].min(initial=low[k]))
        for i in set(ids.tolist()):
            nxt[ids == i] = nxt[ids == i].min()
        if (nxt == low).all():
            break
        low = nxt
    out = [(i, 0, i) for i, _ in rows]
    for k, c, r in zip(ok, link.sum(axis=1).tolist(), low.tolist(), strict=True):
        out[k] = (rows[k][0], c, r)
    return sorted(out, key=str)


def clustered(n, dim, seed, groups=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    at = 0
    for g in groups:
        x[at : at + g] = x[at] + rng.normal(size=(g, dim)) * 0.12
        at += g
    return x.astype(np.float32)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    out = pq_dedup.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in out], key=str)


@pytest.mark.parametrize("options", [{"block_rows": 16}, {}, {"list_rows": 4}, {"lists": 1, "list_rows": 40, "block_rows": 8}])
def test_groups_equal_brute_force(spark, options):
    """Tiles of several blocks, lists of one level and of two."""
    x = clustered(400, 16, 1, (60, 20, 2, 2, 3))
    rows = [(int(7 * k % 401), [float(z) for z in v]) for k, v in enumerate(x)]
    assert run(spark, rows, **options) == brute(rows)


def test_lengths_are_groups_of_their_own(spark):
    rows = [(k, [float(z) for z in v]) for k, v in enumerate(clustered(60, 8, 3, (20, 5)))]
    rows += [(100 + k, [float(z) for z in v]) for k, v in enumerate(clustered(40, 5, 4, (10,)))]
    rows += [(200, [1.0, 2.0]), (201, [1.0, 2.0]), (202, [2.0, 4.1]), (203, [7.0])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (200, 2, 200) in got and (203, 0, 203) in got


@pytest.mark.parametrize("dim", [64, 8, 4, 3])
def test_vectors_of_few_dimensions(spark, dim):
    """3,000 vectors of 64 components that fill a subspace: no link is lost, whatever the borders' directions."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(3000, dim))
    x[:600] = x[rng.integers(600, 3000, 600)] + rng.normal(size=(600, dim)) * 0.2
    x = (x @ np.linalg.qr(rng.normal(size=(64, dim)))[0].T).astype(np.float32)
    want = {i: n for i, n, _ in brute([(k, v.tolist()) for k, v in enumerate(x)])}
    got = {i: n for i, n, _ in run(spark, [(k, v.tolist()) for k, v in enumerate(x)])}
    assert sum(got.values()) >= 0.9995 * sum(want.values()) > 0
    assert dim == 64 or got == want


def test_reach_follows_the_linked_pairs():
    """Displacements along one direction, in vectors that fill all 24: borders are crossed further off than chance has it."""
    rng = np.random.default_rng(9)
    u = pq_dedup.unit_rows(rng.normal(size=(3000, 24)))
    line = np.eye(24)[0]
    v = pq_dedup.unit_rows(u + rng.uniform(-0.3, 0.3, 3000)[:, None] * line)
    both = np.concatenate([u, v])
    index = pq_dedup.Index(both, 40, 1, 4, 64)
    need = index.crossings(both, 0.95)
    assert index.reach(both, 0.95, 0.1) >= np.quantile(need, 0.999) and len(need) > 100
    assert index.reach(both, 0.95, None) == pytest.approx(0.1**0.5) and index.reach(both, 0.95, 3.5) <= 0.1**0.5 + 1e-6


def test_exact_way(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(clustered(500, 6, 11, (90, 40)))]
    assert run(spark, rows, probe_sd=None) == brute(rows)


def test_index_keeps_list_sizes_as_tables_grow():
    rng = np.random.default_rng(6)
    u = pq_dedup.unit_rows(rng.normal(size=(4000, 12)))
    index = pq_dedup.Index(u[:1000], 10, 25, 4, 64)
    home, code, miss = index.encode(u)
    assert index.size == 250 and np.bincount(home).max() < 200
    near = pq_dedup.unit_rows(u + rng.normal(size=u.shape) * 0.06)
    other, _, _ = index.encode(near)
    probes = [set(p.tolist()) for p in index.probes(u, home, index.reach(u[:1000], 0.95, 3.5))]
    back = [set(p.tolist()) for p in index.probes(near, other, index.reach(u[:1000], 0.95, 3.5))]
    met = [a == b or b in p or a in q for a, b, p, q in zip(home, other, probes, back, strict=True)]
    assert np.mean(met) > 0.999 and all(max(p, default=-1) < h for p, h in zip(probes, home, strict=True))


def test_defined_cases(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v), (2, v), (3, [2 * a for a in v]), (4, None), (5, []), (6, [0.0] * 4), (7, [1.0, None, 3.0, 4.0]), (8, [nan, 1.0, 1.0, 1.0]), (9, [inf, 1.0, 1.0, 1.0]), (10, [1.0, 2.0]), (11, [-a for a in v]), (None, v), (12, [3e38, 0.0, 0.0, 0.0]), (13, [1.0, 0.0, 0.0, 0.0])]
    rows += [(11, [0.0, 0.0, 0.0, 5.0]), (20, [0.0, 0.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1), (2, 0, 2)]


def test_query_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {i: (n, c) for i, n, c in brute(rows)}
    out = queries.op7_embedding_duplicates(spark, sf).collect()
    assert len(out) == len(rows)
    assert sum(r["n_links"] for r in out) >= 0.999 * sum(n for n, _ in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in out)
