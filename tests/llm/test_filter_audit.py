"""The filter audit against every order applied to every document."""

import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

from pyspark.sql import functions as F

from sparkloom.llm import filter_audit as A, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and t in first and i > first[t]]
        parts[lang or ""].append((dict(zip("ABCDE", fails, strict=True)), i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        share = defaultdict(int)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                share[f] += len(gone)
                fail = [r for r in rows if r[0][f]]
                only = sum(sum(r[0].values()) == 1 for r in fail)
                out[part, "".join(order), step] = [f, len(left), len(gone), len(fail) - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(share[v[0]])
    return {k: tuple(v) for k, v in out.items()}


def rows(df):
    got = [(tuple(r)[:3], tuple(r)[3:]) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "fr"), (3, None, None), (4, "", ""), (None, long, "en"), (None, None, None), (5, "A b # A A A", "en"), (5, "A b # A A A", "en"), (6, "w " * 300, "de"),
            (7, "é漢🙂 A", "en"), (8, long.upper(), "en"), (9, long + " $", "fr"), (10, " \t\n", "de"), (11, "a\x1cb" * 250, "de"), (0, long + " $", "en")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (None, 1, 1), (5, None, 1), (6, 1, None), (99, 1, 1)]
    d, n = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    d = d.withColumns({"mask": F.lit("clash"), "part": F.lit("clash"), "n": F.lit(1), "good": F.lit("clash"), "digest": F.lit(0)})
    n = n.withColumns({"part": F.lit("clash"), "n": F.lit(0)})
    assert rows(A.audit(A.mask_counts(d, n))) == plain(docs, labels)
    assert A.audit(A.mask_counts(d.limit(0), n)).count() == 0
    assert rows(A.audit(A.mask_counts(d, n.limit(0)))) == plain(docs, [])


def test_a_third_of_rows_are_copies(spark):
    docs = [(i, "same text" if i % 3 else f"text {i} " * (i % 120), "en" if i % 5 else "fr") for i in range(600)]
    labels = [(i, i % 2, i % 7 == 0) for i in range(0, 600, 3)]
    got = A.audit(A.mask_counts(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], LABELS)))
    assert rows(got) == plain(docs, labels)


def test_polynomial():
    counts = {0: 5, 1: 2, 3: 7, 31: 4, 20: 1, 30: 2}
    poly = A.removal_polynomial(counts)
    for m in range(32):
        chosen = frozenset(i for i in range(5) if m >> i & 1)
        assert A.corner(poly, chosen) == sum(c for k, c in counts.items() if k & m)
    for i in range(5):
        # the integral of a mask's derivative along the diagonal is one share in as many as it has filters
        assert A.diagonal_integral(poly, i) == sum((Fraction(c, m.bit_count()) for m, c in counts.items() if m >> i & 1), Fraction(0))


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert rows(queries.op12_filter_audit(spark, sf)) == plain(docs, labels)
