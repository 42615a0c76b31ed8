"""Scalar functions over text, dates and numbers (F1-F28), as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_text(d: Column) -> Column:
    """calendar date as text (never the week year)."""
    return F.date_format(d, "yyyy-MM-dd")


def concat_strict(*parts: Column | str) -> Column:
    """concatenation in which one null makes the whole null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def join_parts(parts: list[Column], sep: str = " | ") -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def labelled(label: str, value: Column, none: str | None = None) -> Column:
    """"label: value"; a null value is left out, or rendered as `none`."""
    v = value.cast("string")
    return F.concat(F.lit(f"{label}: "), v if none is None else F.coalesce(v, F.lit(none)))


def array_text(a: Column, sep: str = ", ") -> Column:
    """F5."""
    return F.array_join(a, sep)


def prefix(s: Column, n: int = 500) -> Column:
    """the first n code points."""
    return F.substring(s, 1, n)


def strip(s: Column) -> Column:
    """F8: trims Unicode white space, not only blanks."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def word_count(s: Column) -> Column:
    """number of words under Unicode white space; 0 for an empty text."""
    return F.size(F.filter(F.split(s, r"(?U)\s+"), lambda x: x != ""))


def ascii_only(s: Column) -> Column:
    """empty becomes null first; then what is not ASCII goes (so a text of accents alone becomes empty)."""
    return F.regexp_replace(F.nullif(s, F.lit("")), r"[^\x00-\x7F]", "")


def falsy_default(s: Column, default: str) -> Column:
    """default for null and for the empty text."""
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def skill_key(name: Column, category: Column, level: Column, category_default: str = "Autres", level_default: str = "Intermédiaire") -> list[Column]:
    """the normalised key under which skills are the same."""
    return [F.lower(strip(name)), strip(falsy_default(category, category_default)), strip(falsy_default(level, level_default))]


def vector_rounded(v: Column, digits: int = 7) -> Column:
    """F13."""
    return F.transform(v, lambda x: F.round(x.cast("double"), digits).cast("float"))


def blank_items_null(a: Column) -> Column:
    """empty items of an array become null."""
    return F.transform(a, lambda x: F.nullif(x, F.lit("")))


def linear_cost(tokens: Column, price_per_million: Column | float) -> Column:
    """F16."""
    p = price_per_million if isinstance(price_per_million, Column) else F.lit(float(price_per_million))
    return tokens * p / F.lit(1e6)


def milliseconds(seconds: Column) -> Column:
    """truncated, not rounded."""
    return (seconds * 1000).cast("bigint")


def percent(score: Column) -> Column:
    """halves round up, for negatives as well."""
    return F.floor(score * 100 + 0.5)


def clock(epoch_ms: Column) -> Column:
    """HH:MM in the session's time zone."""
    return F.date_format(F.timestamp_millis(epoch_ms), "HH:mm")


def duration_text(ms: Column) -> Column:
    """minutes rounded up, as "N min", "Hh" or "Hh Mmin"."""
    m = F.ceil(ms / 60000).cast("bigint")
    h, rest = F.floor(m / 60).cast("bigint"), m % 60
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.concat(h.cast("string"), F.lit("h "), rest.cast("string"), F.lit("min")))


def deep_link(kind: Column, item_id: Column) -> Column:
    """F24."""
    return F.concat(F.lit("/cv#"), kind, F.lit("-"), item_id.cast("string"))


def plural(n: Column, singular: str) -> Column:
    """F25."""
    return F.when(n > 1, F.lit(singular + "s")).otherwise(F.lit(singular))


def basename(path: Column) -> Column:
    """F26."""
    return F.regexp_extract(path, r"[^/]+$", 0)


def kilobytes(content: Column) -> Column:
    """F28."""
    return F.floor(F.octet_length(content) / 1024).cast("bigint")


def new_id() -> Column:
    """a random UUID for each row; stage the rows before using it twice."""
    return F.expr("uuid()")


def valid_message(s: Column, least: int = 1, most: int = 1000) -> Column:
    """P10: 1 to 1000 characters and not blank."""
    return F.coalesce(F.length(s).between(least, most) & (strip(s) != ""), F.lit(False))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))
