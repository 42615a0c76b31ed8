"""WARC bundles: round trip, seek tables, index look-ups and revisits."""

import base64
import hashlib

import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from sparkloom.llm import queries, warc_bundles as W

HTML = ["<p>one</p>", "", None, "<p>one</p>", "é漢字 \r\n\r\n Content-Length: 3\r\n\r\nWARC/1.1", "x" * 300_000, "", "<p>two</p>", "<p>one</p>"]


def table(spark, n=1):
    rows = [(k * len(HTML) + i, f"http://h/{k}/{i}" if i % 4 else None, h) for k in range(n) for i, h in enumerate(HTML)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("frame", F.lit(1))


def want(rows):
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        first = last[h or ""] == i
        out.append((i, u, "response" if first else "revisit", None if first else last[h or ""], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), b if first else None))
    return sorted(out)


def test_round_trip(spark):
    df = table(spark, 3)
    index = W.write_bundles(df, W.bundle_dir(spark), frame_bytes=2000, bundle_bytes=4000)
    back = W.read_bundles(index)
    rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    got = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in back.collect())
    assert got == want(rows)


def test_frames_are_read_by_many_tasks(spark):
    """One bundle of many frames: its ranges are dealt over the partitions, and a payload larger than a frame stays whole."""
    df = table(spark, 12).coalesce(1)
    index = W.write_bundles(df, W.bundle_dir(spark), frame_bytes=2000)
    assert index.select("path").distinct().count() == 1 and index.select("frame").distinct().count() >= 16
    back = W.read_bundles(index, frames_a_range=1)
    tasks = {r[0] for r in back.select(F.spark_partition_id()).distinct().collect()}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((r["page_id"], r["payload_bytes"]) for r in back.collect())
    assert got == sorted((r["page_id"], len((r["html"] or "").encode())) for r in df.collect())
    assert index.where("length > 2000").count() > 0


def test_index_and_seek_table(spark):
    index = W.write_bundles(table(spark, 3), W.bundle_dir(spark), frame_bytes=2000)
    rows = index.collect()
    store, _ = fs.FileSystem.from_uri(W._root_uri(index))
    for path in {r["path"] for r in rows}:
        mine = [r for r in rows if r["path"] == path]
        with store.open_input_file(path) as f:
            frames = W.read_seek_table(f)
            f.seek(0)
            whole = f.read()
        assert sorted({(r["frame_offset"], r["frame_bytes"]) for r in mine}) == [(a, c) for a, c, _ in frames]
        for r in mine:  # each frame stands alone, and each record at its offset
            raw = zstandard.ZstdDecompressor().decompress(whole[r["frame_offset"] : r["frame_offset"] + r["frame_bytes"]])
            rec = next(W.parse(raw[r["offset"] : r["offset"] + r["length"]]))
            assert rec[0] == r["page_id"]
        # a plain decoder reads the whole bundle and skips the table
        d = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
        assert len(d) == sum(n for _, _, n in frames)
    some = index.where("page_id in (5, 13, 26)")
    assert sorted(r["page_id"] for r in W.fetch(some).collect()) == [5, 13, 26]


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, "u", "b"), (7, "u\r\nX: y", "a"), (7, "u", "a"), (3, "u", "a")], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in W.read_bundles(W.write_bundles(df, W.bundle_dir(spark))).collect())
    assert got == [("3", "revisit", 7), ("7", "response", None), ("7", "response", None), ("None", "response", None), ("None", "revisit", 7)]
    assert W.read_bundles(W.write_bundles(df.limit(0), W.bundle_dir(spark))).count() == 0


def test_query(spark, sf):
    pages = [(r["page_id"], None, r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op2_warc_bundles(spark, sf).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect())
    assert got == [(w[0], *w[2:6]) for w in want(pages)]


def test_folders_by_path_and_by_uri(spark, tmp_path):
    """The folder need not lie in the store of the checkpoint folder, and may be written in any form."""
    for k, form in enumerate((str, lambda p: f"file:{p}", lambda p: f"file://{p}/")):
        index = W.write_bundles(table(spark, 2), form(tmp_path / f"b{k}"))
        assert {r["folder"] for r in index.select("folder").distinct().collect()} == {f"file://{tmp_path}/b{k}"}
        assert W.read_bundles(index).count() == W.fetch(index).count() == index.count() > 0
