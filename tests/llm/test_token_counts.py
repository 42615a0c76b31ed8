"""Token counts against the tokenizers library over whole texts."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import queries, token_counts as C


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: len(t.encode(s or "", add_special_tokens=False).ids)


EDGE = [None, "", " ", "\n\n\n", "a", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext", "é漢字🙂 x", "a  b   c", "don't I'LL we've", "x" * 40_000, "word " * 9_000, " lead", "trail ", "tab\there", "1234567 8", "a b", "\x00\x01", "_a _b __ c"]


def test_edge_texts(spark, library):
    df = spark.createDataFrame(list(enumerate(EDGE)) + [(99, "again"), (99, "again")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = [(r["doc_id"], r["n_tokens"]) for r in C.count_tokens(df).collect()]
    assert sorted(got) == sorted([(i, library(t)) for i, t in enumerate(EDGE)] + [(99, library("again"))] * 2)
    assert C.count_tokens(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1_ é漢\n\t'.-🙂"), max_size=120))
def test_cuts_change_nothing(library, text):
    enc = C.encoder("byte_bpe_50k.json")
    parts = C.chunks(text, 7)
    assert "".join(parts) == text
    assert sum(len(enc.ids(p)) for p in parts if p) == library(text)


def test_batches_are_balanced_by_bytes_and_whole():
    parts = [(i, "é" * (i % 7)) for i in range(100)]
    out = list(C.balanced(iter(parts), 20))
    assert [p for b in out for p in b] == parts
    assert all(20 <= sum(len(t.encode()) for _, t in b) <= 20 + 12 for b in out[:-1])


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_each_batch_is_one_call(library, limit, monkeypatch):
    enc, calls = C.encoder("byte_bpe_50k.json"), []
    batch = enc.batch
    monkeypatch.setattr(enc, "batch", lambda texts: calls.append(len(texts)) or batch(texts))
    assert C.lengths(EDGE, enc, limit).tolist() == [library(t) for t in EDGE]
    assert sum(calls) == sum(len(C.chunks(t)) for t in EDGE if t) and (limit < 1 << 20 or len(calls) == 1)


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_token_counts(spark, sf).collect():
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), library(t), library(t) > 1024)
