"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress independently; a bundle ends
with a seek table in a skippable frame (the public seekable format: 8 bytes a
frame, then frame count, descriptor and magic). An index table maps every
record identifier to its bundle, frame and offset within the frame.

Executors write bundles straight into the shared folder, each attempt under a
name of its own; the index, written by Spark's own commit protocol, names the
bundles that count, so a lost or repeated attempt leaves only a stray file.

Defined cases: a null payload is empty; a null url writes no target header; a
null id gives record id ``urn:page:null``; of equal payloads the record with
the largest id is the response and the others are revisits of it (rows
repeating that id are responses too); an empty table gives no bundle and an
empty index; further columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import new_path, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, path string, frame int, frame_offset long, frame_bytes long, offset long, length long, folder string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple]:
    """The records of a frame, as rows of RECORDS; payloads are checked against their digests."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        h = dict(x.split(": ", 1) for x in lines[1:])
        size = int(h["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        cut = block.index(b"\r\n\r\n")
        n = int(dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])["Content-Length"])
        payload = block[cut + 4 :] if h["WARC-Type"] == "response" else None
        found = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if payload is not None and (len(payload) != n or digest(payload) != found):
            raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
        number = lambda s: None if s is None or s == "<urn:page:null>" else int(s[10:-1])
        yield number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], number(h.get("WARC-Refers-To")), n, found, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, raw bytes) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * each)
    body, out, at = f.read(n * each), [], 0
    for k in range(n):
        c, d = struct.unpack_from("<II", body, k * each)
        out.append((at, c, d))
        at += c
    return out


def roles(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """pages with _payload (binary), _revisit, _refers.

    Only payloads that occur more than once enter the join: a table written
    first, which Catalyst broadcasts if its size allows.
    """
    p = pages.withColumn("_payload", F.coalesce(F.col(payload_col), F.lit("")).cast("binary"))
    p = p.withColumn("_sha", F.sha1("_payload")).withColumn("_len", F.octet_length("_payload"))
    twice = p.groupBy("_sha", "_len").agg(F.max(id_col).alias("_refers"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    j = p.join(written(twice, "warc-copies"), ["_sha", "_len"], "left")
    revisit = F.coalesce(~F.col(id_col).eqNullSafe(F.col("_refers")) & F.col("_refers").isNotNull(), F.lit(False))
    return j.withColumn("_revisit", revisit)


def write_bundles(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Write WARC bundles below the folder `out` (a path or URI, in any store); returns the index (written, too).

    An index row has the folder's URI, which names the store, and the bundle's path there.
    """
    out = as_uri(out)
    rows = roles(pages.select(id_col, url_col, payload_col), id_col, payload_col)
    rows = rows.select(F.col(id_col).cast("long"), url_col, "_payload", F.col("_refers").cast("long"), "_revisit")
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        comp = zstandard.ZstdCompressor(level=level)
        part = TaskContext.get().partitionId()
        f, path, frames, size = None, "", [], 0
        held: list[bytes] = []
        meta: list[tuple] = []
        raw = 0

        def frame() -> list[tuple]:
            nonlocal f, path, frames, size, held, meta, raw
            if f is None:
                path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.warc.zst"
                f, frames, size = store.open_output_stream(path, compression=None), [], 0
            data = comp.compress(b"".join(held))
            f.write(data)
            done = [(i, f"urn:page:{'null' if i is None else i}", path, len(frames), size, len(data), a, n, out) for i, a, n in meta]
            frames.append((len(data), raw))
            size += len(data)
            held, meta, raw = [], [], 0
            return done

        def close() -> None:
            nonlocal f
            if f is not None:
                f.write(seek_table(frames))
                f.close()
                f = None

        as_batch = lambda d: pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in d], schema)
        for b in batches:
            for i, url, payload, refers, revisit in zip(*[c.to_pylist() for c in b.columns], strict=True):
                r = record(i, url, payload, refers, revisit)
                meta.append((i, raw, len(r)))
                held.append(r)
                raw += len(r)
                if raw >= frame_bytes:
                    yield as_batch(frame())
                    if size >= bundle_bytes:
                        close()
        if held:
            yield as_batch(frame())
        close()

    return written(rows.mapInArrow(run, INDEX), "warc-index")


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def read_bundles(index: DataFrame, frames_a_range: int = 16) -> DataFrame:
    """All records of the bundles that the index names, frame by frame through their seek tables.

    A task reads ranges of frames: the frame number alone says where in the
    seek table a range lies, and ranges of one bundle go to different tasks.
    Frames hold about as many bytes each, so equal ranges are equal work.
    """
    spark = index.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for path, part, folder in zip(*[c.to_pylist() for c in b.columns], strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as f:
                    for at, c, d in read_seek_table(f)[part * frames_a_range : (part + 1) * frames_a_range]:
                        f.seek(at)
                        yield _rows_batch(list(parse(unpack.decompress(f.read(c), max_output_size=d))))

    ranges = index.select("path", F.floor(F.col("frame") / frames_a_range).cast("int").alias("part"), "folder").distinct()
    # a count without keys deals rows in turn, whatever the planner knows of their order, and stays as it is
    return ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, RECORDS)


def fetch(index: DataFrame) -> DataFrame:
    """The records of the rows of an index (select the wanted identifiers from it first).

    Each wanted frame is read once, by its offset alone.
    """
    frames = index.groupBy("folder", "path", "frame_offset", "frame_bytes").agg(F.collect_set("offset").alias("offsets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, path, at, n, offsets in zip(*[c.to_pylist() for c in b.columns], strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as f:
                    f.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(f.read(n))
                rows = [next(parse(data[o:])) for o in offsets]
                yield _rows_batch(rows)

    return frames.mapInArrow(run, RECORDS)


def as_uri(path: str) -> str:
    """A path with its scheme: `/x` and `file:/x` become `file:///x`."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return path.rstrip("/")


def _root_uri(index: DataFrame) -> str | None:
    """The folder of an index's bundles, whose store holds them."""
    row = index.select("folder").first()
    return row[0] if row else None


def bundle_dir(spark: SparkSession) -> str:
    return as_uri(new_path(spark, "warc"))
