"""WARC bundles in seekable Zstandard: independent frames of records, with a seek table at the end.

A bundle is a file of Zstandard frames; each frame holds whole records, and the last, skippable frame is
the seek table of the public seekable format. The index maps a record's id to bundle, frame and the
record's offset within the frame, so that one record costs one ranged read and one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import keep, table
from knotwork.session import scratch_path

#: Bytes of records in a frame, compressed bytes in a bundle, and the shortest payload that is revisited.
FRAME_BYTES, BUNDLE_BYTES, REVISIT_BYTES = 256 << 10, 16 << 20, 100
WARC_DATE = "2000-01-01T00:00:00Z"

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "bundle string, page_id {kind}, record_id string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The last frame: compressed and raw size of every frame, their number, flags, magic number."""
    body = b"".join(struct.pack("<II", packed, raw) for packed, raw in frames)
    body += struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and raw size of every frame."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    first = len(bundle) - 9 - count * width
    for i in range(count):
        packed, raw = struct.unpack_from("<II", bundle, first + i * width)
        out.append((at, packed, raw))
        at += packed
    return out


def _quoted(page_id) -> str:
    """An id that is a text may hold line breaks and blanks at its ends; a header may not."""
    return quote(str(page_id), safe="")


def record(record_id: str, url: str | None, payload: bytes, digest: str, page_id, refers_to) -> bytes:
    """One WARC record. A revisit has no payload; its length and digest are those of the full payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {_quoted(page_id)}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {_quoted(refers_to)}")
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(frame: bytes):
    """Yield ``(headers, payload, offset, length)`` of the records of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, frame[start:stop], at, stop + 4 - at
        at = stop + 4


class Bundle:
    """Gathers records into frames and frames into one file's bytes."""

    def __init__(self):
        self.done: list[bytes] = []
        self.frames: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.rows: list[tuple] = []
        self.at = 0
        self.size = 0

    def add(self, key, record_id: str, data: bytes):
        self.rows.append((key, record_id, len(self.frames), self.size, len(data)))
        self.open.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self):
        if self.open:
            packed = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(self.open))
            self.done.append(packed)
            self.frames.append((len(packed), self.size))
            self.at += len(packed)
            self.open, self.size = [], 0

    def finish(self) -> tuple[bytes, list[tuple]]:
        self.close_frame()
        offsets = [0]
        for packed, _ in self.frames:
            offsets.append(offsets[-1] + packed)
        rows = [(key, rid, f, offsets[f], self.frames[f][0], at, n) for key, rid, f, at, n in self.rows]
        return b"".join([*self.done, seek_table(self.frames)]), rows


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Columns page_id, url, html, digest, refers_to. Rows below the length limit meet nothing in the join."""
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"),
        (F.octet_length(html) >= REVISIT_BYTES).alias("long"),
    )
    digests = rows.filter("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = digests.filter("n > 1").select(F.col("digest").alias("key"), "first")
    # Short payloads are spread by id, so that equal ones do not gather in one task.
    key = F.when(F.col("long"), F.col("digest")).otherwise(F.concat(F.lit("short "), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))))
    found = rows.withColumn("key", key).join(first, "key", "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    refers = F.when(F.col("page_id").isNull(), F.col("first")).otherwise(refers)
    return found.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row into bundles below ``folder``; return the index of what was written.

    ``folder`` must be reachable by every executor. A bundle is written to a name of its own; only bundles
    in the index count, so what a lost task left behind is never read. Of equal payloads of at least
    ``REVISIT_BYTES`` bytes the row with the smallest id is stored and the others revisit it; rows that
    share that smallest id are all stored. Null html is an empty payload; a null id is never referred to;
    further columns are dropped; an empty table writes nothing.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    names = [c.split(" ")[0] for c in INDEX.split(", ")]

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        bundle = Bundle()

        def finish():
            name = f"{uuid.uuid4().hex}.warc.zst"
            data, rows = bundle.finish()
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array([name] * len(rows)), pa.array(columns[0], key_type)] + [pa.array(c) for c in columns[1:]]
            arrays[3] = arrays[3].cast(pa.int32())
            return pa.RecordBatch.from_arrays(arrays, names=names)

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in batch.columns)
                record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}"
                bundle.add(page_id, record_id, record(record_id, url, html.encode(), digest, page_id, refers_to))
                if bundle.at >= BUNDLE_BYTES:
                    yield finish()
                    bundle = Bundle()
        if bundle.rows:
            yield finish()

    rows = with_revisits(pages, id_col, url_col, html_col)
    return keep(rows.mapInArrow(run, INDEX.format(kind=kind)), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the indexed bundles: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload. Digests of stored payloads are checked while reading."""
    spark = index.sparkSession
    kind = index.schema["page_id"].dataType.simpleString()
    number = kind in ("bigint", "int", "smallint", "tinyint")
    schema = f"bundle string, page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py().rsplit("/", 1)[-1], batch.column(1)[i].as_py()
                for at, packed, raw in read_seek_table(data):
                    frame = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=raw)
                    rows = []
                    for head, payload, _, _ in parse(frame):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                        ids = [head.get(h) for h in ("X-Page-ID", "X-Refers-To-Page-ID")]
                        page_id, refers_to = [x if x is None else int(x) if number else unquote(x) for x in ids]
                        rows.append((name, page_id, head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers_to, payload))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    key = pa.int64() if number else pa.string()
    types = [pa.string(), key, pa.string(), pa.int64(), pa.string(), pa.string(), key, pa.binary()]
    if number and kind != "bigint":
        types[1] = types[6] = {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    if index.limit(1).count() == 0:
        return spark.createDataFrame([], schema).drop("bundle")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    found = files.select("path", "content").mapInArrow(run, schema)
    return found.join(index.select("bundle").distinct(), "bundle", "left_semi").drop("bundle")


def lookup(index: DataFrame, folder: str, ids: DataFrame) -> DataFrame:
    """The records of some pages: one ranged read and one frame each. ``ids`` has a column page_id."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = batch.to_pylist()
            payloads = []
            for r in rows:
                with store.open_input_file(f"{root}/{r['bundle']}") as file:
                    file.seek(r["frame_offset"])
                    frame = zstandard.ZstdDecompressor().decompress(file.read(r["frame_bytes"]))
                part = frame[r["record_offset"] : r["record_offset"] + r["record_bytes"]]
                payloads.append(next(parse(part))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payloads, pa.binary())], names=["page_id", "payload"])

    found = index.join(ids.select("page_id").distinct(), "page_id", "left_semi")
    rows = found.select("page_id", "bundle", "frame_offset", "frame_bytes", "record_offset", "record_bytes")
    return rows.mapInArrow(run, f"page_id {index.schema['page_id'].dataType.simpleString()}, payload binary")


def op1(spark, sf_dir):
    folder = scratch_path(spark, "warc")
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_bundles(index, folder).drop("payload", "url")
