"""Golden cases of the scalar and vector functions."""

import math

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vector as V


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def s(x):
    return F.lit(x).cast("string")


def test_text(spark):
    assert one(spark, T.ascii_only(s("")), T.ascii_only(s("éà")), T.ascii_only(s("aé b")), T.ascii_only(s(None))) == (None, "", "a b", None)
    assert one(spark, T.word_count(s("")), T.word_count(s("  ")), T.word_count(s(" a b  c ")), T.word_count(s("one"))) == (0, 0, 3, 1)
    assert one(spark, T.strip(s("\t a "))) == ("a",)
    assert one(spark, T.concat_strict(s("a"), "-", s(None)), T.join_parts([s("a"), s(""), s(None), s("b")])) == (None, "a | b")
    assert one(spark, T.prefix(s("é" * 600))) == ("é" * 500,)
    assert one(spark, T.labelled("X", s(None)), T.labelled("X", s(None), "None"), T.falsy_default(s(""), "d")) == (None, "X: None", "d")
    assert one(spark, *T.skill_key(s(" Python "), s(""), s(None))) == ("python", "Autres", "Intermédiaire")
    assert one(spark, T.basename(s("/a/b/c.pdf")), T.deep_link(s("formation"), F.lit(3)), T.plural(F.lit(2), "x"), T.plural(F.lit(1), "x")) == ("c.pdf", "/cv#formation-3", "xs", "x")
    assert one(spark, T.blank_items_null(F.array(s("a"), s("")))) == (["a", None],)
    assert one(spark, T.array_text(F.array(s("a"), s("b")))) == ("a, b",)


def test_numbers(spark):
    assert one(spark, T.percent(F.lit(0.125)), T.percent(F.lit(-0.005)), T.percent(F.lit(0.005))) == (13, 0, 1)
    assert one(spark, T.duration_text(F.lit(1)), T.duration_text(F.lit(3_600_000)), T.duration_text(F.lit(3_660_001)), T.duration_text(F.lit(0))) == ("1 min", "1h", "1h 2min", "0 min")
    assert one(spark, T.milliseconds(F.lit(1.9999)), T.clock(F.lit(3_900_000).cast("bigint"))) == (1999, "01:05")
    assert one(spark, T.linear_cost(F.lit(3), 0.13).cast("decimal(10,6)").cast("double")) == (0.0,)
    assert one(spark, T.valid_message(s("")), T.valid_message(s("   ")), T.valid_message(s("x" * 1000)), T.valid_message(s("x" * 1001)), T.valid_message(s(None))) == (False, False, True, False, False)


def test_vectors(spark):
    a = V.literal([3.0, 4.0])
    assert one(spark, V.dot(a, a), V.norm(a)) == (25.0, 5.0)
    assert one(spark, V.cosine(V.dot(a, a), V.norm(a) * V.norm(a))) == (1.0,)
    z = V.literal([0.0, 0.0])
    got = one(spark, V.cosine(V.dot(a, z), V.norm(a) * V.norm(z)))[0]
    assert math.isnan(got)
    assert one(spark, V.passes(F.lit(float("nan")), 0.13), V.passes(F.lit(0.13), 0.13), V.passes(F.lit(0.12), 0.13)) == (False, True, False)
    assert abs(one(spark, T.vector_rounded(F.array(F.lit(0.123456789))))[0][0] - 0.1234568) < 1e-8
