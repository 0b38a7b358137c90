"""WARC archives: writing, normalising monolithic gzip files, and reading by a sidecar index.

An archive that was compressed as one gzip stream cannot be read at a record.  The
normaliser inflates such a stream once, from start to end, writes every record again
as a gzip member of its own, and beside the archive an index with one JSON line a
record: offset, length, id, type.  Records then are read one by one at their offsets.

The writer holds one Arrow batch of pages (512 rows, or the rows that 16 MB take, but at
least one whole page), which it compresses chunk by chunk; the normaliser and the reader hold
one header and one chunk, never an archive, an index or a payload.  Files are written under
a temporary name and moved when complete, under names that follow from the task's partition,
so a repeated task replaces its own file with an equal one.  They are reached through
``pyarrow.fs``, by the URI of the shared folder.

Defined cases: a null html is an empty payload; a null url has no target header; rows
without page_id are written and come back without one, and no record refers to them.
Of rows repeated with the response's page_id and payload, one is the response and the
others revisit it.  A table without rows gives no archive.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, settle, shared_dir

#: Payloads of at least so many bytes are written once; equal ones refer to them.
REVISIT_BYTES = 1000
CHUNK = 1 << 18
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_NAMES = [c.split()[0] for c in _RECORD.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in _RECORD.split(", ")]
#: Rows of a batch of records read.
ROWS = 4096


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _write_whole(uri: str, write: Callable[[BinaryIO], None]) -> None:
    """Write under another name, then move."""
    fs, path = _open(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    fs.move(part, path)


# -- records -------------------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_head(name: str, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """What stands before the payload in a WARC/1.1 response, or all of a revisit but the line ends after it."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{name}>"), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if refers_to is not None:
        head += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    block = len(http) + (size if refers_to is None else 0)
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(block))]
    text = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + text.encode() + b"\r\n" + http


def record(name: str, url: str | None, payload, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """One WARC/1.1 record in pieces: a response with its payload, or a revisit without."""
    yield record_head(name, url, len(payload), digest, refers_to)
    if refers_to is None:
        view = memoryview(payload)
        for at in range(0, len(view), CHUNK):
            yield view[at : at + CHUNK]
    yield b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Inflated:
    """The bytes of a gzip file, one member or many, as one forward stream."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.held, self.over = raw, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        while not self.over:
            data = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"") or self.raw.read(CHUNK)
            if not data:
                self.over = True
                if not self.z.eof:
                    raise EOFError("the gzip stream is cut off")
                break
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, CHUNK)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end."""
        at = self.held.find(mark)
        while at < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise EOFError("a record is cut off")
                return None
            at = self.held.find(mark, seen)
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in chunks."""
        while n:
            if not self.held and not self._more():
                raise EOFError("a record is cut off")
            out = bytes(self.held[:n])
            del self.held[:n]
            n -= len(out)
            yield out


def normalise(raw: BinaryIO, out: BinaryIO, index: Callable[[dict], None]) -> int:
    """Rewrite an archive with one gzip member a record; returns the number of records."""
    stream, offset, n = Inflated(raw), 0, 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = headers(head)
        z, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        length += out.write(z.compress(head))
        for piece in stream.take(int(fields["content-length"]) + 4):  # the block and the two line ends after it
            length += out.write(z.compress(piece))
        length += out.write(z.flush())
        index({"offset": offset, "length": length, "record_id": fields["warc-record-id"], "record_type": fields["warc-type"]})
        offset, n = offset + length, n + 1
    return n


def read_member(raw: BinaryIO) -> dict:
    """The fields of the one member that ``raw`` holds, the payload's size and SHA-1, and whether that is the one recorded.

    The payload is hashed chunk by chunk while it is inflated and never held.
    """
    stream = Inflated(raw)
    head = stream.until(b"\r\n\r\n")
    if head is None:
        raise EOFError("no record")
    fields = headers(head)
    sha, size, found, http = hashlib.sha1(), 0, False, b""
    for piece in stream.take(int(fields["content-length"])):
        if not found:
            http += piece
            at = http.find(b"\r\n\r\n")
            if at < 0:
                continue
            found, piece = True, http[at + 4 :]
        sha.update(piece)
        size += len(piece)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    return {"fields": fields, "size": size, "digest": digest, "intact": revisit or sha.hexdigest() == digest}


class Part:
    """The next ``length`` bytes of a file as a stream of its own."""

    def __init__(self, raw: BinaryIO, length: int):
        self.raw, self.left = raw, length

    def read(self, n: int) -> bytes:
        out = self.raw.read(min(n, self.left))
        self.left -= len(out)
        return out


# -- tables --------------------------------------------------------------------------------------------------------------


def planned(pages: DataFrame) -> DataFrame:
    """Rows page_id, url, body, digest, copy, refers_to, one per page; copy counts rows repeated with page_id and payload.

    Rows without page_id are never referred to and need no number (copy is 0), so they are dealt
    by payload only to learn what they revisit, in a join that adaptive execution can split.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    p = p.withColumn("digest", F.sha1("body"))
    long_ones = p.where(F.octet_length("body") >= REVISIT_BYTES).select("page_id", "digest")
    first = long_ones.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("c")).where("c > 1 AND response IS NOT NULL").drop("c")
    # joined by page and payload, not by payload, of which one may hold a third of all rows
    roles = long_ones.where("page_id IS NOT NULL").distinct().join(first, "digest")
    named = p.where("page_id IS NOT NULL").join(roles, ["page_id", "digest"], "left")
    named = named.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))
    lead = F.col("response").isNull() | ((F.col("page_id") == F.col("response")) & (F.col("copy") == 1))
    named = named.withColumn("refers_to", F.when(~lead, F.col("response")))
    rest = p.where("page_id IS NULL").join(first, "digest", "left").withColumn("copy", F.lit(0)).withColumn("refers_to", F.col("response"))
    out = ["page_id", "url", "body", "digest", "copy", "refers_to"]
    return named.select(out).unionByName(rest.select(out))


def write_monolithic(plan: DataFrame, folder: str) -> DataFrame:
    """Write each partition of ``plan`` as one archive in one gzip stream; rows (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        path, count = f"{folder}/monolithic/part-{part:06d}.warc.gz", 0

        def write(out: BinaryIO) -> None:
            nonlocal count
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            batch = first
            while batch is not None:
                page, url, body, digest, copy, to = (batch.column(c) for c in ("page_id", "url", "body", "digest", "copy", "refers_to"))
                for i in range(batch.num_rows):
                    name = f":{part}.{count}" if copy[i].as_py() == 0 else f"{page[i].as_py()}" if copy[i].as_py() == 1 else f"{page[i].as_py()}:{copy[i].as_py()}"
                    for piece in record(name, url[i].as_py(), body[i].as_buffer(), digest[i].as_py(), to[i].as_py()):
                        out.write(z.compress(piece))
                    count += 1
                batch = next(batches, None)
            out.write(z.flush())

        _write_whole(path, write)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return settle(plan.mapInArrow(run, "path string, records long"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        yield from batch.column("path").to_pylist()


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive of ``archives`` (path); rows (path, records) of the new ones, index beside as path.idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in _paths(batches):
            new, n = f"{folder}/records/{path.rsplit('/', 1)[1]}", 0
            fs, at = _open(path)

            def write(out: BinaryIO, lines: BinaryIO, fs=fs, at=at) -> None:
                nonlocal n
                with fs.open_input_stream(at, compression=None) as raw:
                    n = normalise(raw, out, lambda e: lines.write(json.dumps(e).encode() + b"\n"))

            # the index goes to its place before the archive, which shows that both are whole
            _write_whole(new, lambda out, new=new, write=write: _write_whole(new + ".idx", lambda lines: write(out, lines)))
            yield pa.RecordBatch.from_pydict({"path": [new], "records": [n]})

    return settle(archives.select("path").mapInArrow(run, "path string, records long"))


def entries(path: str) -> Iterator[dict]:
    """The lines of the index of a normalised archive: offset, length, record_id, record_type."""
    fs, at = _open(path + ".idx")
    with fs.open_input_stream(at, compression=None) as f:
        for line in io.BufferedReader(f, CHUNK):
            yield json.loads(line)


def read_archives(archives: DataFrame) -> DataFrame:
    """The record at each index entry, without its payload: its identity, full payload size and digest, and what it refers to."""

    def page(name: str | None) -> int | None:
        part = (name or "").removeprefix("<urn:x-page:").removesuffix(">").split(":")[0]
        return int(part) if part else None

    def rows(path: str) -> Iterator[tuple]:
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            for e in entries(path):
                f.seek(e["offset"])
                r = read_member(Part(f, e["length"]))
                h = r["fields"]
                size = r["size"] if h["warc-type"] == "response" else int(h["x-payload-length"])
                yield page(h["warc-record-id"]), h.get("warc-target-uri"), size, r["digest"], h["warc-type"], page(h.get("warc-refers-to")), r["intact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in _paths(batches):
            found = rows(path)
            while some := list(islice(found, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _TYPES, strict=True)], names=_NAMES)

    return archives.select("path").mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and read every record back by the index."""
    bounded_batches(pages.sparkSession)
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(normalise_archives(write_monolithic(planned(pages), folder), folder))
