"""Seeds of a batch in pieces of bounded bytes: the same repeats are found."""

from sparkloom.llm import debruijn


def test_pieces_lose_no_repeat(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[k % 3 :] if k % 2 else [f"x{k}{i}" for i in range(40)])) for k in range(20)], "doc_id long, text string").coalesce(1)
    get = lambda: sorted(map(tuple, debruijn.remove_repeats(docs).select("doc_id", "n_removed", "kept_text").collect()))
    whole = get()
    monkeypatch.setattr(debruijn, "SEED_BYTES", 100)
    assert get() == whole and sum(r[1] for r in whole) > 0
