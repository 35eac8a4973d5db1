"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent frames, each holding whole WARC records, and a footer seek table (a skippable frame) with the sizes of all
frames. The index maps a record identifier to its frame and its offset within the frame's content, so one record is read by decoding one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, join_hot, new_path, write_table

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

URN = "urn:x-record:"


def open_fs(uri: str):
    """The file system and path of a folder or file that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def clean(value: str) -> str:
    """A header value: line ends and other controls, and %, as percent codes."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in value)


def headers(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Record-ID", f"<{URN}{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", clean(url) if url is not None else None), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        return headers("response", [*fields, ("Content-Type", "application/http;msgtype=response")], http.encode() + payload)
    more = [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Length", len(payload))]
    return headers("revisit", [*fields, *more, ("Content-Type", "application/http;msgtype=response")], http.encode())


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError(f"a record's length is wrong: {fields}")
    return fields, rest[:n]


class BundleWriter:
    """Writes frames to one file, under another name until it is complete."""

    def __init__(self, folder: str, name: str, level: int) -> None:
        import zstandard

        self.fs, path = open_fs(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.uri = f"{path}/{name}", f"{folder}/{name}"
        self.file = self.fs.open_output_stream(self.path + ".part")
        self.zstd, self.sizes, self.bytes = zstandard.ZstdCompressor(level=level, write_checksum=True), [], 0

    def frame(self, raw: bytes) -> int:
        data = self.zstd.compress(raw)
        self.file.write(data)
        self.sizes.append((len(data), len(raw)))
        self.bytes += len(data)
        return len(self.sizes) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()
        self.fs.move(self.path + ".part", self.path)


class BundleReader:
    def __init__(self, uri: str) -> None:
        self.fs, path = open_fs(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        entries = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, raw = struct.unpack_from("<II", entries, 8 * i)
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, i: int) -> bytes:
        import zstandard

        at, packed, raw = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=raw)

    def close(self) -> None:
        self.file.close()


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, in SQL functions: each five hexadecimal digits are four base32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row into bundles in `folder`; returns the index, one row a frame: (bundle, frame, records), records having the id, offset and length.

    Of rows with equal payloads of at least min_bytes, the one with the smallest id is a response and the others are revisits of it; rows that
    repeat that id are responses too, and so are all rows of a payload that no non-null id has. Every task writes files of its own name; those
    of lost attempts are in no index.
    """
    spark, payload = pages.sparkSession, F.coalesce(F.col(html), F.lit("")).cast("binary")
    arrow_batches(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    digest = sha1_base32(F.col("payload"))
    same = rows.where(F.octet_length("payload") >= min_bytes).select("id", digest.alias("d"), F.octet_length("payload").alias("n"))
    same = same.groupBy("d", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1 and first is not null")
    same = write_table(same.select("d", "n", "first", "m"), "same")
    rows = rows.withColumn("digest", digest).withColumn("bytes", F.octet_length("payload"))
    if not same.isEmpty():  # rows of very frequent payloads, the empty one among them, are not shuffled
        rows = join_hot(rows, same, [("digest", "d"), ("bytes", "n")], "m", same.agg(F.sum("m")).first()[0], "left", None)
    else:
        rows = rows.withColumn("first", F.lit(None).cast(dict(rows.dtypes)["id"]))
    rows = rows.select("id", "url", "payload", "digest", F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).cast("string").alias("refers"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stem, bundles, writer = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None
        raw, size, held, done, id_type = [], 0, [], [], None

        def flush() -> None:
            nonlocal writer, raw, size, held, bundles
            if not held:
                return
            if writer is None:
                writer = BundleWriter(folder, f"bundle-{stem}-{bundles:04d}.warc.zst", level)
                bundles += 1
                writer.frame(headers("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            done.append((writer.uri, writer.frame(b"".join(raw)), held))
            raw, size, held = [], 0, []
            if writer.bytes >= bundle_bytes:
                writer.close()
                writer = None

        def out() -> pa.RecordBatch:
            entry = pa.struct([("id", id_type), ("offset", pa.int64()), ("length", pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int32()), pa.array([x[2] for x in done], pa.list_(entry))], names=["bundle", "frame", "records"])

        for b in batches:
            id_type = b.schema.field(0).type
            for i, url_, payload_, digest_, refers in zip(*(b.column(j).to_pylist() for j in range(5))):
                data = record("" if i is None else str(i), url_, payload_, digest_, refers, date)
                held.append({"id": i, "offset": size, "length": len(data)})
                raw.append(data)
                size += len(data)
                if size >= frame_bytes:
                    flush()
        flush()
        if writer is not None:
            writer.close()
        if done:  # after close(): an index row is only there when its bundle is complete
            yield out()

    return write_table(rows.mapInArrow(run, f"bundle string, frame int, records array<struct<id: {kind}, offset: bigint, length: bigint>>"), "warc_index")


def read(index: DataFrame, id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """All records of an index, each frame decoded once: (id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]). Digests of stored payloads are checked."""
    arrow_batches(index.sparkSession)
    kind = index.schema["records"].dataType.elementType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_now, name = None, None
        for b in batches:
            for bundle, frame, records in zip(*(b.column(j).to_pylist() for j in range(3))):
                if bundle != name:
                    if open_now:
                        open_now.close()
                    open_now, name = BundleReader(bundle), bundle
                raw, out = open_now.frame(frame), []
                for r in records:
                    fields, block = parse(raw[r["offset"] : r["offset"] + r["length"]])
                    body, of = block.partition(b"\r\n\r\n")[2], fields["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if of == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not fit its digest")
                    refers = fields.get("WARC-Refers-To")
                    out.append((r["id"], fields.get("WARC-Target-URI"), int(fields.get("WARC-Payload-Length", len(body))), digest, of, refers and refers[1 + len(URN) : -1], body if with_payload and of == "response" else None))
                cols = list(zip(*out))
                types = [b.schema.field(2).type.value_type.field(0).type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "url", "n", "digest", "type", "refers", "payload"])
        if open_now:
            open_now.close()

    got = index.mapInArrow(run, f"id {kind}, url string, n long, digest string, type string, refers string, payload binary")
    out = [F.col("id").alias(id_col), "url", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to")]
    return got.select(*out, *(["payload"] if with_payload else []))


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes all pages to bundles (in the shared folder, unless another is named), and reads them back.

    Nulls: an html counts as empty, a url gives no target, an id gives a record without one. A very long page is a record, and a frame, of its own
    size. Repeated rows are written each. Extra columns, also of the result's names, are ignored; an empty table gives an empty result.
    """
    return read(write(pages, folder or new_path(pages.sparkSession, "warc"), id_col, url, html, min_bytes), id_col)
