"""WARC archives: one gzip member per record, written and read by the executors.

Writing: a payload digest decides which records are responses and which revisit an equal one; each task then
writes its records to archives of bounded size in the shared folder. File names carry the task attempt, and
only files that a committed task listed in the manifest are read, so retries do no harm.

Reading is sequential and incremental: zlib inflates a little at a time, Content-Length frames the block, and
digests are computed while the bytes pass, so memory does not depend on the size of a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm.batches import mapped

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
MOST_HEADER = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header of the full payload but not its bytes."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{_base32(hashlib.sha1(payload).digest())}"),
        ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = store.opened(folder)
        where.create_dir(root, recursive=True)
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, path, count, number = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page, url, html, refers, revisit in zip(*(batch[c].to_pylist() for c in ("page", "url", "html", "refers", "revisit")), strict=True):
                if out is None:
                    path, count, number = f"{folder}/{attempt}-{number:04d}.warc.gz", 0, number + 1
                    out = where.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                out.write(record(page, url, html.encode(), refers, revisit))
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record per row; returns (path, records) of the archives, itself kept beside them.

    Null html is an empty payload. Of records with equal payloads of ``least_bytes`` or more, those with the
    smallest key are responses (a repeated key is the same page) and the others revisit it; null keys come
    last, and if all keys are null all are responses. Extra columns are ignored.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary"))))
    shared = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("page").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = rows.join(shared, "digest", "left")  # a hot payload is split by AQE's skew join: the other side has one row
    revisit = F.col("refers").isNotNull() & ~F.col("page").eqNullSafe(F.col("refers"))
    mapped(found.select("page", "url", "html", "refers", revisit.alias("revisit")), _writer(folder), "path string, records bigint").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("path string, records bigint").parquet(f"{folder}/manifest")


class _Bytes:
    """Inflated bytes of one file, taken piece by piece across gzip members."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.inflate, self.held = stream, b"", None, b""

    def more(self) -> bool:
        """Inflates a little more of the current member; false at its end."""
        if self.inflate is None or self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(READ_BYTES)
            if not self.raw:
                raise ValueError("the archive ends inside a record")
        self.held += self.inflate.decompress(self.raw, READ_BYTES)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(READ_BYTES)
        self.inflate, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if at > MOST_HEADER or not self.more():
                raise ValueError("a header has no end")
        found, self.held = self.held[:end], self.held[end + len(mark) :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("a block is shorter than its Content-Length")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def finish(self) -> None:
        while self.more():
            pass
        if self.held != b"\r\n\r\n":
            raise ValueError("a record doesn't end after its Content-Length")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdigit() else None


def records(stream, with_payload: bool) -> Iterator[tuple]:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, valid, payload) of each record."""
    data = _Bytes(stream)
    while data.next_member():
        head = _fields(data.until(b"\r\n\r\n"))
        length = int(head["content-length"])
        whole, body = hashlib.sha1(), hashlib.sha1()
        http, size, parts = b"", -1, []  # size < 0: still in the HTTP header
        for piece in data.take(length):
            whole.update(piece)
            if size < 0:
                http += piece
                before, mark, piece = http.partition(b"\r\n\r\n")
                if not mark:
                    if len(http) > MOST_HEADER:
                        raise ValueError("an HTTP header has no end")
                    continue
                http, size = before, 0
            size += len(piece)
            body.update(piece)
            if with_payload:
                parts.append(piece)
        data.finish()
        told = head.get("warc-payload-digest", "").removeprefix("sha1:")
        valid = head.get("warc-block-digest", "").removeprefix("sha1:") == _base32(whole.digest())
        revisit = head["warc-type"] == "revisit"
        digest = told if revisit else _base32(body.digest())
        full = int(_fields(http).get("content-length", "0")) if revisit else max(size, 0)
        yield (
            _page(head.get("warc-record-id")), head.get("warc-target-uri"), full, digest, head["warc-type"],
            _page(head.get("warc-refers-to")) if revisit else None, valid and (revisit or told == digest), b"".join(parts) if with_payload and not revisit else None,
        )


SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("valid", pa.bool_()), ("payload", pa.binary()),
])


def read(manifest: DataFrame, *, path: str = "path", with_payload: bool = True) -> DataFrame:
    """A row per record of the archives at ``path``; valid: all digests hold. Broken framing raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["path"].to_pylist():
                where, name = store.opened(uri)
                rows, held = [], 0
                with where.open_input_stream(name, compression=None) as stream:
                    for r in records(stream, with_payload):
                        rows.append(r)
                        held += 200 + len(r[-1] or b"")
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, x, strict=True)) for x in rows], schema=SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, x, strict=True)) for x in rows], schema=SCHEMA)

    spec = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, valid boolean, payload binary"
    return mapped(manifest.select(F.col(path).alias("path")).repartition(max(1, manifest.count())), run, spec)  # a task per file
