"""Vector functions (M1, M2) and their traps: null, zero and clamped cosines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """M2: L2 norm; computed once a corpus row."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(dp: Column, norms: Column) -> Column:
    """M1 from a dot product and the product of norms: NaN for a zero vector,
    clamped to [-1, 1] otherwise (clamping a NaN would make it a perfect match)."""
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dp / F.when(norms == 0, F.lit(1.0)).otherwise(norms))))


def literal(vec: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vec])


def passes(score: Column, threshold: float) -> Column:
    """P5: inclusive, and never for NaN."""
    return ~F.isnan(score) & (score >= threshold)
