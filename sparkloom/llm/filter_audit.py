"""Filter interaction audit: what each filter removes in every order, and its Shapley value.

Every document is judged once by every filter; what is counted is only how many
documents of a part fail which set of filters (a mask). From these counts a part's
removal polynomial is formed, the multilinear extension of "documents removed by a
set of filters": its value at a corner of the cube is what that set removes, and the
integral of its partial derivative along the diagonal is the filter's Shapley value.
Coefficients and integrals are exact.

Defined cases: a null text is the empty one, a null part the empty string. A copy is
a row whose text some smaller id has, anywhere in the table; a row without an id is no
copy and makes none. Rows that repeat an id all count, and are no copies of each other.
A document is good (toxic) if any of its labels says so; labels without an id count for
nothing, null labels as 0. An empty table gives no part and so no row. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, words_of

FILTERS = "ABCDE"
AUDIT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters(text: Column, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3, symbols: str = "#$%&*|") -> list[Column]:
    """Whether a text fails the filters that look at it alone: short, repetitive, upper case, symbols."""
    w = words_of(text)
    return [
        F.regexp_count(text, F.lit(WORD)) < min_words,
        100 * F.size(F.array_distinct(w)) < distinct_percent * F.size(w),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > upper_percent * F.length(text).cast("long"),
        F.length(F.translate(text, symbols, "")) < F.length(text),
    ]


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: the documents of a part that fail exactly the filters of the mask.

    Rows leave the text at once: id, part, bits and digest are what is shuffled, first
    by id to meet the labels, then by digest. A text with very many copies is one
    partial sum for each task, part and label, so that no task gets its rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = F.lit(0)
    for k, fails in enumerate(text_filters(text)):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    # an id is once in a group, as its labels are its own; so the rows of the least id can be told from the rest
    has = F.col("doc_id").isNotNull()
    alike = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("with_id"), F.min(F.when(has, F.struct("doc_id", "n"))).alias("least"))
    least = alike.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    alike = alike.join(least, "digest")
    copies = F.col("with_id") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct((F.col("n") - copies).alias("n"), F.col("mask").alias("mask")), F.struct(copies.alias("n"), F.col("mask").bitwiseOR(F.lit(16)).alias("mask")))
    each = alike.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    total = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good"), total("toxic"))


def removal_polynomial(counts: dict[int, int], n_filters: int = 5) -> dict[frozenset[int], int]:
    """Coefficients, by set of variables, of the sum over masks of count * (1 - product over the mask's filters of (1 - x))."""
    out: dict[frozenset[int], int] = {}
    for size in range(1, n_filters + 1):
        for s in map(frozenset, combinations(range(n_filters), size)):
            bits = sum(1 << i for i in s)
            if c := sum(v for m, v in counts.items() if m & bits == bits):
                out[s] = c if size % 2 else -c
    return out


def corner(poly: dict[frozenset[int], int], chosen: frozenset[int]) -> int:
    """The polynomial where the chosen variables are 1 and the others 0: what these filters remove together."""
    return sum(c for s, c in poly.items() if s <= chosen)


def diagonal_integral(poly: dict[frozenset[int], int], i: int) -> Fraction:
    """The partial derivative by variable i, integrated over the diagonal from 0 to 1."""
    powers: dict[int, int] = {}
    for s, c in poly.items():
        if i in s:
            powers[len(s) - 1] = powers.get(len(s) - 1, 0) + c
    return sum((Fraction(c, p + 1) for p, c in powers.items()), Fraction(0))


def part_audit(part: str, counts: dict[int, tuple[int, int, int]], filters: Sequence[str] = FILTERS) -> Iterator[tuple]:
    """Rows of AUDIT: every order of the filters, step by step."""
    k = len(filters)
    docs, good, toxic = ({m: c[j] for m, c in counts.items()} for j in range(3))
    polys = [removal_polynomial(x, k) for x in (docs, good, toxic)]
    at = [{s: corner(p, s) for r in range(k + 1) for s in map(frozenset, combinations(range(k), r))} for p in polys]
    shares = [diagonal_integral(polys[0], i) * factorial(k) for i in range(k)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a Shapley value over all orders is no whole number")
    total = sum(docs.values())
    for order in permutations(range(k)):
        before: frozenset[int] = frozenset()
        for step, i in enumerate(order, 1):
            after = before | {i}
            removed, good_lost, toxic_lost = (v[after] - v[before] for v in at)
            yield part, "".join(filters[j] for j in order), step, filters[i], total - at[0][after], removed, at[0][frozenset({i})] - removed, docs.get(1 << i, 0), good_lost, toxic_lost, int(shares[i])
            before = after


def audit(counts: DataFrame) -> DataFrame:
    """The audit of mask_counts: 120 orders of 5 steps for each part. A group has 32 rows at most."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"], strict=True)}
        return pd.DataFrame(part_audit(key[0], masks), columns=[x.split()[0] for x in AUDIT.split(", ")])

    return counts.groupBy("part").applyInPandas(one, AUDIT)
