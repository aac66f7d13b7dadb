"""WARC writing with revisit resolution, and reading back.

Payloads are never shuffled. A first pass spools them, compressed, to the shared folder, and tells of each only a header: digest, size and
place. Headers are grouped by digest, so that a payload that a third of all pages share costs one row for each task, and joined with
the originals of their digest. Then each task goes once through one task's spool, in the order in which it was written, and writes archives of
its own with fresh headers: a response record with its payload, or a revisit record that refers to the original response.
Reading parses the archives record by record and computes digests anew from the payloads it finds.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.bytewords import open_in, open_out
from inkwell.llm.native_text import broadcast_if_small
from inkwell.session import materialize, remove_path, scratch_path

LEAST_BYTES = 1000
ROLL_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = 1 << 20
#: Different payloads that occur several times and are broadcast; about 50 bytes each. More of them are joined by a shuffle of headers.
MOST_ORIGINALS = 500_000
_HEADER = "page_id long, url string, digest binary, size long, part int, path string, at long, length long"


def record_id(page_id: int | None) -> str:
    """A record's URI; the same for the same page in every run."""
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}')}"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def spool(pages: DataFrame, folder: str) -> DataFrame:
    """Store every payload of ``pages`` (page_id, url, html) in files of the shared folder; return the headers: digest and size, and where
    the payload lies."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        out, path, at = None, None, 0
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        for batch in batches:
            for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                if out is None:
                    out, path = open_out(folder, "spool")
                    at = 0
                data = packer.compress(payload)
                out.write(data)
                rows.append((page.as_py(), url.as_py(), hashlib.sha1(payload).digest(), len(payload), part, path, at, len(data)))
                at += len(data)
                if at >= ROLL_BYTES:
                    out.close()
                    out = None
                if len(rows) >= 10_000:
                    yield _rows(rows)
                    rows = []
        if out is not None:
            out.close()
        if rows:
            yield _rows(rows)

    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.binary()), ("size", pa.int64()), ("part", pa.int32()), ("path", pa.string()),
        ("at", pa.int64()), ("length", pa.int64())])

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, _HEADER)


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``headers`` (page_id, digest, size) with refers_to: of pages with equal payloads of at least
    ``least_bytes`` bytes, the largest page_id is the original and the others refer to it."""
    heads = headers.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    heads = broadcast_if_small(materialize(heads.where("n > 1").drop("n"), "originals"), MOST_ORIGINALS)
    joined = headers.join(heads, ["digest", "size"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str | None = None) -> DataFrame:
    """Write a record for each row and return the archives (path, n_records). ``date`` is that of all records, by default now.

    A null html is an empty payload; a null url becomes ``urn:page:ID``. Rows that repeat a page_id each get a record.
    With no page_id (null) a page can refer to others, not be referred to, unless all its equals lack one too: then
    all are responses. An empty table writes nothing. Payloads of any size are held one at a time; columns other than page_id, url and html
    are ignored.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        unpacker = zstandard.ZstdDecompressor()
        out, url, n, size = None, None, 0, 0
        source, path, place = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if source is not None:
                        source.close()
                    path, place = row["path"], 0
                    source = open_in(path)
                to, page = row["refers_to"], row["page_id"]
                payload = b""
                if to is None:
                    while place < row["at"]:  # payloads of revisits are passed over
                        place += len(source.read(min(_READ, row["at"] - place)))
                    payload = unpacker.decompress(source.read(row["length"]))
                    place += row["length"]
                if out is None:
                    out, url = open_out(folder, "pages")
                    head = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(None)}>"), ("WARC-Date", date),
                                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(head)
                headers = [
                    ("WARC-Type", "revisit" if to is not None else "response"), ("WARC-Record-ID", f"<{record_id(page)}>"),
                    ("WARC-Date", date), ("WARC-Target-URI", row["url"] or f"urn:page:{page}"),
                    ("WARC-Payload-Digest", f"sha1:{row['digest'].hex()}"), ("Page-ID", "" if page is None else str(page)),
                    ("Payload-Length", str(row["size"])), ("Content-Type", "application/http; msgtype=response")]
                if to is not None:
                    headers += [("WARC-Refers-To", f"<{record_id(to)}>"), ("WARC-Refers-To-Page", str(to)), ("WARC-Profile", PROFILE)]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
                data = _record(headers, http + payload)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [url], "n_records": [n]})
                    out, n, size = None, 0, 0
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [url], "n_records": [n]})

    spark = pages.sparkSession
    spooled = scratch_path(spark, "warc-spool")
    headers = materialize(spool(pages, spooled), "headers")
    parts = (headers.agg(F.max("part")).first()[0] or 0) + 1
    dealt = resolve(headers, least_bytes).repartitionById(parts, F.col("part")).sortWithinPartitions("path", "at")
    archives = materialize(dealt.mapInArrow(run, "path string, n_records long"), "archives")
    remove_path(spark, spooled)
    return archives


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each gzip member of an archive; one record is held at a time."""
    unpacker, held, rest = None, [], b""
    while True:
        data = rest or stream.read(_READ)
        if not data:
            if held:
                raise ValueError("an archive ends inside a record")
            return
        unpacker = unpacker or zlib.decompressobj(31)
        held.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        if unpacker.eof:
            head, _, block = b"".join(held).partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(headers["content-length"])
            if not version.startswith("WARC/") or block[size:] != b"\r\n\r\n":
                raise ValueError("an archive holds a damaged record")
            yield headers, block[:size]
            unpacker, held = None, []


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, html) of every record of the archives. html is
    null for a revisit, whose size and digest are those of its headers; a response's are computed from its payload,
    and a digest that differs from the header's is an error."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with open_in(path) as stream:
                    for headers, block in records(stream):
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        stated = headers["warc-payload-digest"].removeprefix("sha1:")
                        revisit = headers["warc-type"] == "revisit"
                        payload = block.partition(b"\r\n\r\n")[2]  # after the head of the HTTP message
                        digest = stated if revisit else hashlib.sha1(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"the payload of {headers['warc-record-id']} in {path} is damaged")
                        rows.append({
                            "page_id": int(headers["page-id"]) if headers["page-id"] else None, "url": headers["warc-target-uri"], "record_type": headers["warc-type"],
                            "payload_bytes": int(headers["payload-length"]) if revisit else len(payload), "payload_digest": digest,
                            "refers_to": int(headers["warc-refers-to-page"]) if revisit else None, "html": None if revisit else payload.decode("utf-8", "surrogatepass")})
                        size += len(block)
                        if size > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    dealt = archives.select("path").repartition(max(1, archives.count()))
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string")


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("html", pa.string())])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return read(spark, write(pages, folder))


REVISIT_SQL = """
WITH p AS (SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM o
"""
