"""Co-training: held-out accuracy, and each step on small data."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import cotraining, queries

DOC = "doc_id long, text string, source string, lang string, n_chars long, quality string"


def test_newton_fits_a_separable_and_a_noisy_set():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    x[:, 4] = 3.0  # a constant column gets no weight
    y = (x[:, 0] - 2 * x[:, 1] + 0.3 > 0).astype(float)
    w = cotraining.logistic(x, y, np.ones(400), 1e-3)
    assert ((cotraining.logit(x, w) > 0) == (y > 0)).mean() > 0.97 and w[4] == 0
    noisy = np.where(rng.random(400) < 0.1, 1 - y, y)
    assert ((cotraining.logit(x, cotraining.logistic(x, noisy, np.ones(400), 1e-3)) > 0) == (y > 0)).mean() > 0.93


def rows_of(spark, y, bits, meta):
    """Written views: two words and no shape; y is nan where unlabelled."""
    n = len(meta)
    rows = [(np.zeros(9, np.float32).tobytes(), int(meta[k]), np.packbits(bits[k]).tobytes(), None if np.isnan(y[k]) else float(y[k]), k % 5) for k in range(n)]
    return spark.createDataFrame(rows, "shape binary, meta int, bits_0 binary, y_0 double, fold int")


def plain_co_training(y, bits, meta, rounds, confident, weight, l2=1e-3):
    """Co-training on full rows in plain NumPy."""
    x = np.hstack([np.zeros((len(y), 9)), bits]).astype(float)
    one = cotraining.meta_matrix()[meta]
    fold, own = np.arange(len(y)) % 5, ~np.isnan(y)
    tr, bound = own & (fold != 0), np.log(confident / (1 - confident))
    mean, sd = x.mean(axis=0), x.std(axis=0)
    inv = np.where(sd > 1e-6, 1 / np.where(sd > 1e-6, sd, 1), 0)
    z = np.hstack([(x - mean) * inv, np.ones((len(x), 1))])

    def fit(a, use, t, w):
        b = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-a[use] @ b))
            pen = np.append(np.full(a.shape[1] - 1, l2 * w[use].sum()), 1e-9)
            b -= np.linalg.solve((a[use] * (w * 1.0)[use][:, None] * (p * (1 - p))[:, None]).T @ a[use] + np.diag(pen), a[use].T @ (w[use] * (p - t[use])) + pen * b)
        return b

    st = sm = np.zeros(len(y))
    for r in range(rounds + 1):
        new = []
        for a, other in ((z, sm), (None, st)):
            sure = ~own & (np.abs(other) >= bound) & (r > 0)
            use, t, w = tr | sure, np.where(tr, np.nan_to_num(y), other > 0), np.where(tr, 1.0, weight)
            if a is None:
                m, s = one[use].mean(axis=0), one[use].std(axis=0)
                a = np.hstack([(one - m) * np.where(s > 1e-9, 1 / np.where(s > 1e-9, s, 1), 0), np.ones((len(one), 1))])
            new.append(a @ fit(a, use, t, w))
        st, sm = new
    return st, sm


def test_heads_equal_plain_co_training_on_full_rows(spark):
    """Few labels, many unlabelled documents: every one of them takes part, in any partitioning."""
    rng = np.random.default_rng(2)
    truth = (rng.random(2500) < 0.5).astype(float)
    y = np.where(np.arange(2500) < 60, truth, np.nan)
    bits = np.stack([rng.random(2500) < 0.1 + 0.75 * truth, rng.random(2500) < 0.9 - 0.75 * truth, rng.random(2500) < 0.5, rng.random(2500) < 0.2 + 0.6 * truth], axis=1)
    meta = ((truth * 16 + rng.integers(0, 16, 2500)) * 240 + rng.integers(0, 240, 2500)).astype(int)
    words = [np.arange(4, dtype=np.uint64)]
    df = rows_of(spark, y, bits, meta)
    h = cotraining.fit_heads(df.repartition(7), ("q",), words, 2, 0.95, 0.5)[0]
    st, sm = plain_co_training(y, bits, meta, 2, 0.95, 0.5)
    x = np.hstack([np.zeros((2500, 9)), bits]).astype(float)
    assert np.allclose(cotraining.logit(x, h.text), st, atol=1e-3) and np.allclose(cotraining.logit(cotraining.meta_matrix()[meta], h.meta), sm, atol=1e-3)
    alone = cotraining.fit_heads(df.where("y_0 is not null"), ("q",), words, 2, 0.95, 0.5)[0]
    right = lambda h: ((cotraining.logit(cotraining.meta_matrix()[meta[60:]], h.meta) > 0) == (truth[60:] > 0)).mean()
    assert right(h) > right(alone) and h.cal[0] > 0


def test_features_of_edge_texts():
    import pyarrow as pa

    texts = pa.array(["", " \n", "Idiot, IDIOT! ok", "École | x!!", "a" * 100_000, "12 34"])
    w, doc = cotraining.bare_words(texts)
    assert np.bincount(doc, minlength=6).tolist() == [0, 0, 3, 2, 1, 0]
    h, d = cotraining.distinct_words(w, doc)
    assert np.bincount(d, minlength=6).tolist() == [0, 0, 2, 2, 1, 0]
    x = cotraining.text_matrix(texts, [np.sort(h[d == 2])])[0]
    assert x[2, cotraining.SHAPE :].tolist() == [1, 1] and np.isfinite(x).all()


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "s", "en", -4, "x"), (None, "a b", "s", "en", 3, "x"), (3, "a", "s", "en", 1, "x"), (3, "a", "s", "en", 1, "x")], DOC)
    labels = spark.createDataFrame([(3, 1, None), (None, 1, 1), (3, 0, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    trained = cotraining.train(docs, labels)
    heads = trained.heads
    out = cotraining.score(docs, heads)
    assert out.count() == 5
    assert sorted(map(str, out.collect())) == sorted(map(str, cotraining.score_views(trained.views, heads).collect()))
    assert out.where("p_toxic = 0.5").count() == 5  # no label of a known document
    assert out.where("p_quality > 0.99").count() == 5  # one class only (a mean of 0.5 counts as 1)
    assert cotraining.score(docs.limit(0), heads).count() == 0
    assert len(cotraining.train(docs.limit(0), labels).heads) == 2
    assert len(cotraining.train(docs.select("doc_id", "text"), labels.limit(0)).heads) == 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    out = cotraining.score(docs, cotraining.train(docs, labels.where(fold != 0)).heads).join(labels.where(fold == 0), "doc_id")
    right = out.select(F.avg(((F.col("p_quality") >= 0.5).cast("int") == F.col("quality")).cast("int")).alias("q"), F.avg(((F.col("p_toxic") >= 0.5).cast("int") == F.col("toxic")).cast("int")).alias("t")).first()
    assert right["q"] > 0.93 and right["t"] > 0.85


def test_query(spark, sf):
    out = queries.op9_quality_classifier(spark, sf)
    assert {"doc_id", "p_quality", "p_toxic", "kept"} <= set(out.columns)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.where("kept is null or kept <> (p_quality >= 0.5 and p_toxic < 0.5)").count() == 0


def test_choice_of_words_equals_a_plain_count(spark, sf):
    """Chi-square over the words of every labelled text, counted in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select(F.col("text").alias("_text"), F.col("quality").cast("double").alias("q"), F.col("toxic").cast("double").alias("t"))
    docs = docs.unionByName(spark.createDataFrame([("", 1.0, None), ("Ünï x-Y 9z", None, 0.0), ("same same", 0.0, 1.0)], docs.schema))
    rows = [tuple(r) for r in docs.collect()]
    got = cotraining._words_by_label(docs, ["q", "t"], 50, 3.0)
    for k, words in enumerate(got, 1):
        own = [(set(re.findall(rb"[a-z\x80-\xff]+", r[0].encode().lower())), r[k]) for r in rows if r[k] is not None]
        n, pos = len(own), sum(y for _, y in own)
        count, hits = Counter(), Counter()
        for ws, y in own:
            count.update(ws)
            hits.update(ws if y else ())
        hashed = {w: int(cotraining.hash_words(pa.array([w.decode()]), lower=False).hash[0]) for w in count}
        chi2 = {hashed[w]: n * (hits[w] * n - m * pos) ** 2 / (m * (n - m) * pos * (n - pos)) for w, m in count.items() if 0 < m < n}
        told = sorted((v for v in chi2.values() if v >= 3.0), reverse=True)[:50]
        assert len(words) == len(told) and len(told) > 5
        assert np.allclose(sorted((chi2[int(w)] for w in words), reverse=True), told)
    assert [len(w) for w in cotraining._words_by_label(docs.where("q = 1"), ["q"], 50, 3.0)] == [0]
