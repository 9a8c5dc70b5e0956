"""WARC archives: a normaliser for monolithic gzip files, with a sidecar offset index.

``write_archives`` writes pages as WARC records into files that are each one gzip stream, as crawlers' tools often
leave them. ``normalise`` inflates every such stream once, front to back, writes each record again as a gzip member
of its own, and a sidecar index (file, offset, length, record). ``read_records`` opens single records by it.

A payload of at least ``LEAST`` bytes that an earlier page_id holds too becomes a revisit of the smallest such page.
Files go to the shared folder through Arrow's file systems, under a name of their own for every attempt of a task;
only the names that finished tasks return are read again, so a lost executor leaves at most unused files.

Nulls: a null html is an empty payload; a null url is ``about:blank``; null page_ids are kept, are always responses and are
referred to by none. Repeated page_ids stay as rows. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, hot_join, slices, stored, work_path

LEAST, FILE_BYTES, LEVEL = 100, 64 << 20, 1
DATE = "1970-01-01T00:00:00Z"
_RECORDS = "page_id long,payload_bytes long,payload_digest string,record_type string,refers_to long"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of its response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def split_stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated WARC stream, whatever its pieces; what is read stays until its chunk is done."""
    held, at, need = bytearray(), 0, None
    for chunk in chunks:
        del held[:at]
        at = 0
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                need = end + 8 - at + int(re.search(rb"\r\nContent-Length: (\d+)", held[at:end], re.I)[1])
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, None
    if held[at:].strip():
        raise ValueError("the archive ends within a record")


def inflate(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A gzip stream in pieces, once; members that follow each other are one stream."""
    at, inflater = 0, zlib.decompressobj(31)
    while at < len(raw) or inflater.unconsumed_tail:
        data = inflater.unconsumed_tail or raw[at : at + step]
        at += 0 if inflater.unconsumed_tail else len(data)
        yield inflater.decompress(data, 4 * step)
        if inflater.eof:
            rest = inflater.unused_data
            inflater = zlib.decompressobj(31)
            at -= len(rest)
    yield inflater.flush()


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    sizes = rows.groupBy("digest").agg(F.min(F.when(F.octet_length("payload") >= least, F.col("page_id"))).alias("first"), F.count("*").alias("n"))
    joined = hot_join(rows, stored(sizes.filter("n > 1"), "digests"), ["digest"], "n", ["page_id", "url"])
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Written table (path, n) of archives that are one gzip stream each."""
    folder = work_path(pages.sparkSession, "warc")
    schema = arrow_schema("path string,n long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, size, n, name, deflater = None, 0, 0, "", None
        for part in slices(batches, 256):
            for row in zip(part["page_id"], part["url"], part["payload"], part["digest"], part["refers_to"], strict=True):
                if out is None:
                    name, deflater, size, n = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                raw = record(*row)
                out.write(deflater.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= file_bytes:
                    out.write(deflater.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": [n]}, schema=schema)
        if out is not None:
            out.write(deflater.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": [n]}, schema=schema)

    return stored(with_revisits(pages).mapInArrow(write, "path string,n long"), "warc-files")


def _open(store_path: str) -> bytes:
    store, path = fs.FileSystem.from_uri(store_path)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def normalise(files: DataFrame) -> DataFrame:
    """Written index (path, offset, length, record_id, page_id) of new archives with one gzip member a record.

    Beside each new archive its index stands as ``.idx``, one JSON object a line.
    """
    folder = work_path(files.sparkSession, "warc-members")
    ddl = "path string,offset long,length long,record_id string,page_id long"
    schema = arrow_schema(ddl)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for part in slices(batches, 1):
            name, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                for raw in split_stream(inflate(_open(part["path"][0]))):
                    headers, _ = parse(raw[: raw.find(b"\r\n\r\n") + 4])
                    deflater = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = deflater.compress(raw) + deflater.flush()
                    out.write(member)
                    page_id = headers.get("X-Page-Id")
                    rows.append({"path": f"{folder}/{name}", "offset": at, "length": len(member), "record_id": headers["WARC-Record-ID"], "page_id": page_id and int(page_id)})
                    at += len(member)
            with store.open_output_stream(f"{base}/{name.removesuffix('.warc.gz')}.idx", compression=None) as out:
                out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return stored(files.select("path").repartition(max(1, files.count()), "path").mapInArrow(rewrite, ddl), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from single members found by the index."""
    schema = arrow_schema(_RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, data = None, None
        for part in slices(batches):
            rows = []
            for at_path, offset, length in zip(part["path"], part["offset"], part["length"], strict=True):
                if at_path != path:
                    path = at_path
                    store, inner = fs.FileSystem.from_uri(path)
                    data = store.open_input_file(inner)
                data.seek(offset)
                headers, block = parse(zlib.decompress(data.read(length), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                page_id, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                kind = headers["WARC-Type"]
                size = len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = hashlib.sha256(payload).hexdigest() if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha256:")
                rows.append({"page_id": page_id and int(page_id), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers and int(refers)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return index.select("path", "offset", "length").mapInArrow(read, _RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as monolithic archives, normalised, and read back record by record."""
    return read_records(normalise(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


_ORACLE5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": _ORACLE5}
