"""Token-id files: exact round trips, and ids against the tokenizers library over whole texts."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import queries, range_coder as C, word_bpe as W

ODD = ["", " ", "a", "it's we're I'LL 'tis ''s x''s 'd'm 'v 'r 'l 're've ' '", "123 4a5b ½²³¹ ºª", "É\xa0À\x85b \x0b\x0c\t x", "<|endoftext|> a", "a<|startoftext|>b", "ß ÄÖ Ÿ ſ ŉ Ĳ", "a-b--c...!?'s", "ﬁ 漢字 é é", "İ i", "\x7f\x1e\x00\x1f", "'",
       "l'avion d'or 'S 'T", "!'s", "s's's", "­· ·a", "x" * 30_000, "word " * 9_000, "🙂🙃", '"', "a b c d"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 1]


def test_ids_of_odd_texts_and_of_the_whole_vocabulary(library):
    enc = W.encoder("word_bpe_49k.json", 1)
    texts = list(ODD)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        byte = W._bytes_of_characters()
        for t in json.load(f)["model"]["vocab"]:
            if byte.keys() >= set(t.removesuffix("</w>")):
                texts.append(bytes(byte[c] for c in t.removesuffix("</w>")).decode("utf-8", "ignore"))
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == library(t), t[:60]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAé1' \n.-stremdlvÿſ½\xa0"), max_size=40), max_size=4))
def test_ids_of_any_text(library, texts):
    assert [x.tolist() for x in W.encoder("word_bpe_49k.json", 1).encode(texts)] == [library(t) for t in texts]


def cases():
    r = np.random.default_rng(7)
    yield np.zeros(1, np.uint16)
    yield np.arange(5, dtype=np.uint16)
    yield np.zeros(30_000, np.uint16)
    yield np.full(2049, 65535, np.uint16)
    yield r.integers(0, 65536, 9_000).astype(np.uint16)
    yield (r.zipf(1.2, 40_001) % 50_000).astype(np.uint16)
    yield np.tile(r.integers(0, 50_000, 37).astype(np.uint16), 900)
    yield np.where(r.random(20_000) < 0.999, 3, 40_000).astype(np.uint16)


@pytest.mark.parametrize("ids", list(cases()), ids=lambda x: f"{len(x)}")
def test_blocks_round_trip_alone_and_together(ids):
    blocks, sizes = C.encode_blocks(ids)
    assert sizes.sum() == len(ids) and sizes.max() <= C.BLOCK and sizes.max() - sizes.min() <= 1
    assert (C.decode_blocks(blocks, sizes) == ids).all()
    ends = np.cumsum(sizes)
    for k in {0, len(blocks) // 2, len(blocks) - 1}:
        assert (C.decode_blocks([blocks[k]], sizes[k : k + 1]) == ids[ends[k] - sizes[k] : ends[k]]).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), min_size=1, max_size=200), st.integers(0, 5))
def test_any_ids_round_trip(ids, more):
    x = np.array(ids * (1 + more), np.uint16)
    assert (C.decode_blocks(*C.encode_blocks(x)) == x).all()


def test_predictions_save_space():
    words = np.random.default_rng(1).integers(0, 49_000, 40)  # few, as every block learns them anew
    text = np.concatenate([words[k : k + 4] for k in np.random.default_rng(2).integers(0, 36, 8_000)]).astype(np.uint16)
    blocks, _ = C.encode_blocks(text)
    order0 = -np.log2(np.unique(text, return_counts=True)[1] / len(text)) @ np.unique(text, return_counts=True)[1] / 8
    assert sum(map(len, blocks)) < 0.75 * order0 < 2 * len(text)


def test_one_interval_an_id(monkeypatch):
    calls, put = [], C._Encoder.put
    monkeypatch.setattr(C._Encoder, "put", lambda self, *args: calls.append(1) or put(self, *args))
    ids = np.random.default_rng(3).zipf(1.3, 6_000).astype(np.uint16)  # many that no context has, and many new to order 0
    _, sizes = C.encode_blocks(ids)
    assert len(calls) == sizes.max()


def test_intervals_are_those_of_plain_arithmetic():
    r, lanes, steps = np.random.default_rng(5), 40, 300
    coder, low, rng, out = C._Encoder(lanes, steps), [0] * lanes, [2**64 - 1] * lanes, [0] * lanes
    for _ in range(steps):
        total = r.integers(2, 1 << 23, lanes)
        size = np.minimum(1 + r.integers(0, 40, lanes), total)
        start = total - size  # at the upper end, so that carries run far
        coder.put(lanes, start, size, total)
        for k in range(lanes):
            each = int(np.float64(np.uint64(rng[k])) * C._BELOW / float(total[k]))
            assert 0 <= rng[k] // int(total[k]) - each <= 1 + (each >> 48)
            low[k], rng[k] = low[k] + int(start[k]) * each, int(size[k]) * each
            if rng[k] < 1 << 32:
                low[k], rng[k], out[k] = low[k] << 32, rng[k] << 32, out[k] + 1
    words, counts = coder.done()
    assert counts.tolist() == [n + 2 for n in out]
    for k, w in enumerate(np.split(words, np.cumsum(counts)[:-1])):
        assert int.from_bytes(w.astype(">u4").tobytes()) == low[k]


def test_letters_are_lowered_ahead_only_where_that_keeps_the_ids(library):
    enc = W.encoder("word_bpe_49k.json", 1)
    for texts in (["The END, the End", "THE\nend"], ["J\u030c H\u0331 T\u0308 W\u030a", "A\u030a I\u0307"], ["<|ENDOFTEXT|> A<|endoftext|>B", "END"], ["\u0130 I ÀB"], ["", None], [None]):
        assert [x.tolist() for x in enc.encode(texts)] == [library(t) for t in texts]


def test_words_that_differ_in_case_are_encoded_once(monkeypatch):
    enc, seen = W.encoder("word_bpe_49k.json", 1), []
    words = enc.words
    monkeypatch.setattr(enc, "words", lambda w: seen.append(len(w)) or words(w))
    enc.encode(["Word word WORD wOrd"] * 3)
    assert seen == [2]  # and the end of a text


def plain(docs, library):
    """docs: (doc_id, text) to (start, n_tokens, crc) in order."""
    out, start = [], 0
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array(library(t), "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def stored(spark, docs):
    ids = C.written(W.encode_documents(docs), "ids")
    out = C.id_dir(spark)
    return C.write_ids(ids, out, file_bytes=1 << 14), out


def test_files(spark, library, monkeypatch):
    monkeypatch.setattr(C, "LANES", 3)
    monkeypatch.setattr(C, "BLOCK", 700)
    docs = [(i * 3 % 101, t) for i, t in enumerate([*ODD, None] * 3)] + [(None, "no id"), (500, "the same"), (500, "the same")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "start": F.lit(0), "_h": F.lit("clash")}).repartition(5)
    files, out = stored(spark, df)
    assert files.count() > 1
    got = sorted(C.read_ids(files, out).collect(), key=lambda r: r["start"])
    assert [tuple(r)[:4] for r in got] == plain(docs, library)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == library(dict(docs)[r["doc_id"]]) for r in got if r["doc_id"] is not None)
    none, out = stored(spark, df.limit(0))
    assert none.count() == 0 and C.read_ids(none, out).count() == 0


def test_ranges_and_damage(spark, library):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), F.col("id").cast("int")).alias("text"))
    files, out = stored(spark, docs)
    store, _ = fs.FileSystem.from_uri(out)
    path = files.orderBy("part").first()["path"]
    with store.open_input_file(path) as f:
        blocks, names, counts = C.read_footer(f)
        whole = np.concatenate(list(C._decoded(f, blocks)))
        assert len(whole) == counts.sum() and len(names) == len(counts)
        for first, n in ((0, 5), (len(whole) - 3, 3), (len(whole) // 2, 1), (17, len(whole) - 40)):
            assert (C.read_range(f, first, n) == whole[first : first + n]).all()
    with open(path, "r+b") as f:
        f.seek(int(blocks[0, 0] + blocks[0, 1] // 2))
        b = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([b[0] ^ 255]))
    with pytest.raises(Exception, match="checksum"):
        C.read_ids(files, out).collect()


def test_query(spark, sf, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_token_files(spark, sf).collect()) == sorted(plain(docs, library))
