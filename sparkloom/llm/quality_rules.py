"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once for each document and stores the
measurements with one failure bit a rule. Policies are versioned sets of
rules; ``apply_policy`` is one bitwise AND over the ledger, and ``ablations``
counts by bitwise aggregation what each rule of a policy decides, without
reading a text again.

Defined cases: a null or blank text has no words and fails the length rule;
texts are never cut; repeated rows are judged alike; an empty table gives an
empty ledger; other columns are kept unless named like a measurement, which
replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WS, words_of

SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """name, and the SQL condition over the measurements under which a document fails."""

    name: str
    fails: str


#: Bit i of the ledger belongs to rule i. Append only: bits never change their meaning.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 25 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("no_words", "n_words = 0"),
)
#: Version -> names of the rules that reject.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length"),
    # for corpora that are packed: a short text is not a poor one
    "v2": ("repeated_windows", "symbols", "duplicate_lines", "word_length", "no_words"),
}


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def _window(words: Column, i: Column) -> tuple[Column, Column, Column]:
    return F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of MEASURES.

    Repeated 3-word windows: a 64-bit hash of each window only tells the
    texts that surely have none; where two are equal, the windows themselves
    are sorted and compared, so a hash collision cannot change a count.
    """
    extra = [c for c in docs.columns if c not in MEASURES]
    t = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(*extra, words_of(F.col(text_col)).alias("_w"), F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "").alias("_l"))
    n = F.size("_w")
    w = F.col("_w")
    many = n >= 3
    at = lambda: F.sequence(F.lit(1), n - 2)
    none = F.array().cast("array<bigint>")
    b = a.select(
        *extra, "_w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(many, F.transform(at(), lambda i: F.xxhash64(*_window(w, i)))).otherwise(none).alias("_h"),
    )
    pair = "array<struct<s:string,i:int>>"
    c = b.select(
        *extra, *[m for m in MEASURES if m != "n_repeat_words"],
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform(at(), lambda i: F.struct(F.concat_ws(" ", *_window(w, i)).alias("s"), i.alias("i"))).cast(pair)))
        .otherwise(F.array().cast(pair)).alias("_s"),
    )
    s = F.col("_s")
    same = lambda x, k: (F.get(s, k - 1)["s"] == x["s"]) | (F.get(s, k + 1)["s"] == x["s"])
    hit = F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
    d = c.select(*extra, *[m for m in MEASURES if m != "n_repeat_words"], hit.alias("_p"))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")),
        lambda acc, x: F.struct((x + 3).alias("e"), (acc["n"] + x + 3 - F.greatest(x, acc["e"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    return d.select(*extra, *[m for m in MEASURES if m != "n_repeat_words"], covered.alias("n_repeat_words"))


def ledger(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with measurements and fail_bits (long): bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs.drop("fail_bits"), text_col).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str = "v1", out: str = "kept", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A boolean column: no rule of the policy failed."""
    return led.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[version], rules)).cast("long")) == 0)


def ablations(led: DataFrame, version: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a rule of the policy: documents it fails, those that only it
    rejects (kept again without it), and all that the policy rejects.

    The ledger is first counted by its masked bits (at most 2 ** rules rows
    leave a task), so the shuffle does not grow with the documents.
    """
    mask = mask_of(POLICIES[version], rules)
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if mask >> i & 1])).alias("r"), "b", "n")
    bit, b = F.col("r.bit"), F.col("b")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.lit(version).alias("policy"), total(b.bitwiseAND(bit) != 0).alias("n_failed"), total(b == bit).alias("n_only"), total(b != 0).alias("n_rejected")
    )
