"""WARC archives by way of a chunked record table.

A record travels as rows of a record id and a chunk number, so writers and readers hold one chunk at a time: the writer
streams chunks into the file under headers that are known before (length and digest), the reader cuts a payload of any
size into chunk rows, each with the bytes and the SHA-256 so far; the last row of a record has those of the whole.

Equal payloads of at least ``least`` bytes are stored once, in the response of the smallest page id; the others become
revisit records that refer to it and repeat its HTTP header. Rows that share that smallest id are all responses; a null
id comes after all others. A null payload is empty; a null URL is written as an empty one.

A task writes files whose names no other attempt uses; only those that the stored index lists are read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stored, text_of
from .records import opened

CHUNK, FILE_BYTES, LEAST = 256 * 1024, 64 * 1024 * 1024, 100
#: Date in the headers of what has no date of its own.
DATE = "2024-01-01T00:00:00Z"

# Names of the standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"

CHUNKS = ("page_id long, url string, payload_bytes long, payload_digest string, refers_to long, is_revisit boolean, "
          "chunk_no int, is_last boolean, chunk binary")
READ = ("path string, record_no long, page_id long, url string, record_type string, refers_to long, "
        "header_bytes long, header_digest string, chunk_no int, is_last boolean, chunk binary, "
        "bytes_so_far long, digest_so_far string")


def chunked(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of ``page_id``, ``url``, ``html``: rows of a record follow each other in order."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                         text_of("html").cast("binary").alias("payload"))
    keyed = keyed.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"),
                         F.sha2("payload", 256).alias("payload_digest"))
    firsts = (keyed.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    firsts = stored(firsts.select("payload_digest", "first"), "repeated-payloads")
    typed = keyed.join(firsts, "payload_digest", "left").withColumn(
        "is_revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    count = F.when(F.col("is_revisit") | (F.col("payload_bytes") == 0), 1).otherwise(
        F.ceil(F.col("payload_bytes") / chunk)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(F.col("is_revisit"), F.lit(b"")).otherwise(
        F.substring(F.col("payload"), i * chunk + 1, F.lit(chunk))))
    return typed.select("page_id", "url", "payload_bytes", "payload_digest", F.when(F.col("is_revisit"), F.col("first")).alias("refers_to"),
                        "is_revisit", count.alias("count"), F.posexplode(pieces).alias("chunk_no", "chunk")).select(
        "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "is_revisit", "chunk_no",
        (F.col("chunk_no") == F.col("count") - 1).alias("is_last"), "chunk")


def headers(page_id: int | None, url: str, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """Everything of a record before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
             f"WARC-Target-URI: {quote(url, safe=_SAFE)}", f"WARC-Date: {DATE}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


_SAFE = "".join(map(chr, range(33, 127))).replace("%", "")


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Stream a chunked record table into archives below ``folder`` (a shared one); the stored index: page_id, path, offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        out, path, at, digest = None, "", 0, None
        try:
            for batch in batches:
                listed: list[tuple] = []
                for row in batch.to_pylist():
                    if row["chunk_no"] == 0:
                        if out is None or at >= file_bytes:
                            if out is not None:
                                out.close()
                            path, at = f"{folder}/{uuid.uuid4().hex}.warc", 0
                            out = files.open_output_stream(opened(path)[1])
                        listed.append((row["page_id"], path, at))
                        head = headers(row["page_id"], row["url"], row["payload_bytes"], row["payload_digest"],
                                       row["refers_to"], row["is_revisit"])
                        out.write(head)
                        at, digest = at + len(head), hashlib.sha256()
                    out.write(row["chunk"])
                    digest.update(row["chunk"])
                    at += len(row["chunk"])
                    if row["is_last"]:
                        if not row["is_revisit"] and digest.hexdigest() != row["payload_digest"]:
                            raise ValueError(f"the chunks of page {row['page_id']} do not have the digest of its payload")
                        out.write(b"\r\n\r\n")
                        at += 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in listed], pa.int64()), pa.array([x[1] for x in listed], pa.string()),
                     pa.array([x[2] for x in listed], pa.int64())], names=["page_id", "path", "offset"])
        finally:
            if out is not None:
                out.close()

    return stored(records.mapInArrow(run, "page_id long, path string, offset long"), "warc-index")


class DamagedArchive(ValueError):
    """A record is cut off or has a header that can't be read."""


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    """Header fields up to the empty line, names in lower case."""
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise DamagedArchive("a header is cut off")
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(RECORD)
    return int(text) if text else None


def parse(stream: io.BufferedReader, chunk: int) -> Iterator[tuple]:
    """Chunk rows of all records of one archive; what is in memory is one chunk."""
    number = 0
    while line := stream.readline():
        if not line.strip():
            continue
        if line.strip().decode() != VERSION:
            raise DamagedArchive(f"no record starts at {line[:40]!r}")
        own = _fields(stream)
        length = int(own["content-length"])
        start = stream.readline()
        http = {}
        used = len(start)
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise DamagedArchive("an HTTP header is cut off")
            used += len(line)
            name, _, value = line.decode().partition(":")
            http[name.strip().lower()] = value.strip()
        left, digest, so_far, k = length - used - 2, hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise DamagedArchive("a payload is cut off")
            left -= len(data)
            so_far += len(data)
            digest.update(data)
            yield (number, _page(own.get("warc-record-id")), unquote(own.get("warc-target-uri", "")), own["warc-type"],
                   _page(own.get("warc-refers-to")), int(http["content-length"]),
                   own["warc-payload-digest"].removeprefix("sha256:"), k, left == 0, data, so_far, digest.hexdigest())
            k += 1
            if not left:
                break
        number += 1


def read(paths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in the column ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in READ.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, inner = opened(path)
                rows, held = [], 0
                with files.open_input_file(inner) as source:
                    for row in parse(io.BufferedReader(source, 1 << 16), chunk):
                        rows.append((path, *row))
                        held += len(row[9])
                        if held >= 4 * chunk or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = stored(paths.select("path").distinct(), "warc-files")
    # A task per file: left alone, Spark would merge the few bytes of the paths into one task that reads everything.
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, READ)


def report(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The length and digest of a response are those of what was read; a revisit has those of its own headers.
    """
    index = write(chunked(pages, least), folder or shared_path(pages.sparkSession, "warc"))
    whole = F.col("record_type") == "response"
    return read(index).where("is_last").select(
        "page_id", F.when(whole, F.col("bytes_so_far")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM g
"""
