"""WARC archives of pages: one gzip stream a file, then a member a record with an offset index.

Tasks write their pages as archives of one gzip stream each. The normaliser
inflates such a stream once, piece by piece, and writes every record again as a
gzip member of its own, with a sidecar index of offsets and lengths, so that any
record can be read by itself. Reading back goes through the index.

Equal payloads of at least ``min_bytes`` are stored once: the least page_id has
the response, the others revisit records. The choice is made on digests; page
bodies are shuffled by page, never by digest, so a body shared by a third of all
pages makes no hot task.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, partitions
from .tokens import sliced

MIN_BYTES = 100
CHUNK = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, n_records long"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None, date: str) -> bytes:
    """One WARC record; ``payload`` None makes it a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if payload is not None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if payload is None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return head + block + b"\r\n\r\n"


class Inflated:
    """The inflated bytes of a gzip stream of one or many members, read once and in pieces."""

    def __init__(self, raw: BinaryIO):
        self._raw, self._z, self._have = raw, zlib.decompressobj(31), bytearray()
        self._rest = b""

    def _more(self) -> bool:
        piece = self._rest or self._raw.read(CHUNK)
        self._rest = b""
        if not piece:
            return False
        if self._z.eof:
            self._z = zlib.decompressobj(31)
        self._have += self._z.decompress(piece, 1 << 20)
        self._rest = bytes(self._z.unconsumed_tail or self._z.unused_data)
        return True

    def read(self, n: int) -> bytes:
        while len(self._have) < n and self._more():
            pass
        out = bytes(self._have[:n])
        del self._have[:n]
        return out

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; b'' at the end of the stream."""
        start = 0
        while (k := self._have.find(mark, start)) < 0:
            start = max(0, len(self._have) - len(mark) + 1)
            if not self._more():
                if self._have:
                    raise ValueError("the archive ends inside a record header")
                return b""
        return self.read(k + len(mark))


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def records(stream: Inflated) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of the records of an archive."""
    while head := stream.until(b"\r\n\r\n"):
        size = int(headers(head)["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("the archive ends inside a record")
        yield head, block


def normalise(raw: BinaryIO, out: BinaryIO, index: BinaryIO, level: int = 6) -> int:
    """Rewrite an archive with a gzip member a record; a line of JSON for each in ``index``."""
    at = n = 0
    for head, block in records(Inflated(raw)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()
        out.write(member)
        h = headers(head)
        line = {"offset": at, "length": len(member), "type": h["warc-type"], "id": h["warc-record-id"], "digest": h.get("warc-payload-digest")}
        index.write(json.dumps(line).encode() + b"\n")
        at += len(member)
        n += 1
    return n


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html (null: empty), digest, size and refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    body = html.cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    keys = pages.where(F.col("size") >= min_bytes).select("digest", "page_id")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    later = keys.join(first, "digest").where("page_id is null and refers_to is not null or page_id > refers_to").distinct()
    later = later.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    joined = pages.join(later, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.drop("_page", "_digest")


def _file_rows(name: str, n: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """One archive of one gzip stream for each partition of ``with_revisits``; a row for each (evaluate once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out, n = None, 0
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        name = f"{uuid.uuid4().hex}.warc.gz"
        for b in sliced(batches, "html"):
            for r in b.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = None if r["refers_to"] is not None else r["html"].encode()
                out.write(z.compress(record(r["page_id"], r["url"], r["digest"], r["size"], payload, r["refers_to"], date)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield _file_rows(name, n)

    return pages.mapInArrow(run, FILES)


def normalise_archives(files: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """Every archive of ``files`` in ``source`` rewritten in ``target``, an index beside it (evaluate once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(source)
        store_out, root_out = pafs.FileSystem.from_uri(target)
        store_out.create_dir(root_out, recursive=True)
        for b in batches:
            for name in b.column("file").to_pylist():
                to = f"{uuid.uuid4().hex}.warc.gz"
                with (
                    store.open_input_stream(f"{root}/{name}", compression=None) as raw,
                    store_out.open_output_stream(f"{root_out}/{to}", compression=None) as out,
                    store_out.open_output_stream(f"{root_out}/{to}.index", compression=None) as index,
                ):
                    n = normalise(raw, out, index, level)
                yield _file_rows(to, n)

    return files.repartition(partitions(files.sparkSession), "file").mapInArrow(run, FILES)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every record by its index entry: digest and size come from the stored payload, or a revisit's header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            for name in b.column("file").to_pylist():
                rows = []
                with store.open_input_file(f"{root}/{name}") as data, store.open_input_stream(f"{root}/{name}.index", compression=None) as index:
                    for line in index.read().splitlines():
                        e = json.loads(line)
                        whole = zlib.decompress(data.read_at(e["length"], e["offset"]), 31)
                        head, rest = whole.split(b"\r\n\r\n", 1)
                        h = headers(head)
                        http, payload = rest[: int(h["content-length"])].split(b"\r\n\r\n", 1)
                        if h["warc-type"] == "response":
                            row = (len(payload), hashlib.sha256(payload).hexdigest(), "response", None)
                        else:
                            size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                            row = (size, h["warc-payload-digest"].removeprefix("sha256:"), "revisit", _page(h["warc-refers-to"]))
                        rows.append((_page(h["warc-record-id"]), *row))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.repartition(partitions(files.sparkSession), "file").mapInArrow(run, READ)


def warc_digest(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages as archives, normalise the archives and read every record back.

    ``pages`` needs ``page_id``, ``url`` and ``html``; other columns are ignored. A
    null html is an empty payload, a null url an empty target. Payloads below
    ``min_bytes`` are always responses. Rows repeated under the least id of a
    payload are all responses; a null id comes after all others and revisits them.
    An empty table gives no archive and no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    whole, split = scratch.path("whole"), scratch.path("members")
    written = scratch.stage(write_archives(with_revisits(pages, min_bytes), whole), "written")
    files = scratch.stage(normalise_archives(written, whole, split), "normalised")
    return read_archives(files, split)


#: The same for DuckDB, over ``pages``.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.digest = d.digest AND d.n >= 100
"""
