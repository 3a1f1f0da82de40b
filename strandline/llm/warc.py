"""WARC archives: written from pages, read back as a table of payload chunks.

Payloads move as chunks of at most `CHUNK` bytes, in both directions. For writing Spark cuts each page into chunk rows, which
reach the writer in order, a batch at a time; it compresses them as they come. Read back, a chunk row has the record's id,
the chunk's number, the bytes so far and the digest so far, so the last row of a record has its whole length and digest.
Python never holds a whole record. Every record is a gzip member of its own.

Of records with equal payloads of at least `least` bytes, the one with the smallest id is the response and the others are
revisits of it, without payload. Pages meet the first ids of their payloads in a join on the digest; payloads of more than a
`1 / HOT` part of all pages, of which there are fewer than HOT, are broadcast instead, so no payload makes one task hot.

Each task writes files of its own in the shared folder and returns their names; only files whose task succeeded are listed,
so retries and lost executors leave no doubles. Reading deals the files to tasks.

Defined results: null html is the empty payload; null urls leave the field out; rows that repeat the smallest id are responses
each, and so are rows with a null id; an empty table gives no file and no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_dir, stored

CHUNK = 1 << 20
#: Bytes of records after which a task begins a new file, so that reading has files to deal out.
FILE = 16 << 20
#: A payload with more than this part of all pages is hot.
HOT = 1000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def roles(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, url, html) with payload (bytes), sha1 and refers_to, the id of the response that a revisit repeats."""
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = sized.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("sha1", "of")
    first = stored(first, "payloads")
    total = pages.count()
    hot, rare = F.broadcast(first.where(F.col("n") * HOT > total)), first.where(F.col("n") * HOT <= total)
    same = F.col("sha1") == F.col("of")
    joined = sized.join(hot, same).unionByName(sized.join(hot, same, "left_anti").join(rare, same, "left"))
    return joined.select("page_id", "url", "payload", "sha1", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def chunked(records: DataFrame) -> DataFrame:
    """A row for each chunk of each record, in order; one without bytes for revisits and empty payloads."""
    n = F.when(F.col("refers_to").isNull(), F.ceil(F.octet_length("payload") / CHUNK)).otherwise(0).cast("int")
    rows = records.withColumn("n_bytes", F.octet_length("payload")).withColumn("chunks", F.greatest(n, F.lit(1)))
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("refers_to").isNull(), F.substr("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)))
    return rows.select("page_id", "url", "sha1", "refers_to", "n_bytes", "chunks", "chunk_no", data.alias("data"))


class Writer:
    """Records as gzip members of one file, written chunk by chunk."""

    def __init__(self, sink: BinaryIO):
        self.sink, self.size = sink, 0

    def begin(self, headers: list[tuple[str, str]], http: bytes, n_bytes: int) -> None:
        self.squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        length = [("Content-Length", str(len(http) + n_bytes))]
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers + length) + "\r\n"
        self.sink.write(self.squeeze.compress(head.encode("utf-8") + http))
        self.size += len(head) + len(http) + n_bytes

    def chunk(self, data: bytes) -> None:
        self.sink.write(self.squeeze.compress(data))

    def end(self) -> None:
        self.sink.write(self.squeeze.compress(b"\r\n\r\n") + self.squeeze.flush())


def begin_page(writer: Writer, page: int | None, url: str | None, sha1: str, refers_to: int | None, n_bytes: int) -> None:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode("ascii")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(sha1))}"), ("X-Payload-Length", str(n_bytes))]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    writer.begin(headers, http, n_bytes if refers_to is None else 0)


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages (page_id, url, html) to archives in the shared folder; returns their names (path, records)."""
    folder = shared_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(top, recursive=True)
        writer, path, records = None, "", 0

        def closed() -> pa.RecordBatch:
            writer.sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["path", "records"])

        for batch in pieces(batches, 64):
            for page, url, sha1, refers_to, n_bytes, chunks, chunk_no, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    path, records = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    writer = Writer(store.open_output_stream(f"{top}/{path.rpartition('/')[2]}", compression=None))
                if chunk_no == 0:
                    begin_page(writer, page, url, sha1, refers_to, n_bytes)
                writer.chunk(data or b"")
                if chunk_no + 1 == chunks:
                    writer.end()
                    records += 1
                    if writer.size >= FILE:
                        yield closed()
                        writer = None
        if writer is not None:
            yield closed()

    return stored(chunked(roles(pages, least)).mapInArrow(run, "path string, records long"), "warc-files")


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Header fields and payload chunks of each record; the chunks are to be taken before the next record."""
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := source.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        while left and (line := source.readline(left)):
            left -= len(line)
            if line in (b"\r\n", b"\n"):
                break

        def body(left: int = left) -> Iterator[bytes]:
            while left and (data := source.read(min(left, CHUNK))):
                left -= len(data)
                yield data

        yield fields, body()


def _id(field: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", field or "")
    return int(found[1]) if found else None


READ = "page_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk_no int, data binary, bytes_so_far long, digest_so_far string, is_last boolean"


def read(files: DataFrame, data: bool = True) -> DataFrame:
    """The chunk table of the archives (path). data False: the chunks are read and digested, but their bytes left out."""
    n = max(1, files.count())
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_())])

    def rows(source: BinaryIO) -> Iterator[dict]:
        for fields, body in records(source):
            sha, size = hashlib.sha1(), 0
            row = {"page_id": _id(fields.get("warc-record-id")), "record_type": fields["warc-type"], "refers_to": _id(fields.get("warc-refers-to")), "declared_bytes": int(fields["x-payload-length"]), "declared_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
            number, chunk = 0, next(body, b"")
            while chunk is not None:
                sha.update(chunk)
                size += len(chunk)
                after = next(body, None)
                yield row | {"chunk_no": number, "data": chunk if data else None, "bytes_so_far": size, "digest_so_far": base32(sha.digest()), "is_last": after is None}
                number, chunk = number + 1, after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path if ":" in path.partition("/")[0] else f"file://{path}")
                with gzip.GzipFile(fileobj=store.open_input_stream(name, compression=None)) as source:
                    block, size = [], 0
                    for row in rows(source):
                        block.append(row)
                        size += len(row["data"] or b"")
                        if size >= 4 * CHUNK or len(block) >= 2048:
                            yield pa.RecordBatch.from_pylist(block, schema=schema)
                            block, size = [], 0
                    if block:
                        yield pa.RecordBatch.from_pylist(block, schema=schema)

    return files.select("path").repartition(n, "path").mapInArrow(run, READ)
