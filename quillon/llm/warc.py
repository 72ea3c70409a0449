"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

The reader deals byte ranges of the archives to tasks. A task scans its range for the gzip magic,
validates a candidate by inflating it and decoding its record header, owns every record that starts
inside its range, follows members from end to start without scanning, and reads past the end of the
range where its last record needs it. So any range size gives each record exactly once, and no
archive is read by one task alone.

Archives and ranges go through pyarrow.fs: local and mounted folders, and any store it has.

Defined results: null payload is an empty one; of equal payloads of at least `revisit_bytes` the
smallest id (nulls last) is the response, and rows that repeat that very id are responses too; a
null url is written as an empty target; an empty table gives no archive and an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, materialize, released, scratch

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 18
RANGE = 32 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme lies in the cluster's default file system."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if "://" in path or path.startswith("file:") or default.startswith("file:") else default.rstrip("/") + path


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- writing


def record(kind: str, record_id: str, target: str, date: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One gzip member: WARC header, HTTP header, and the payload of a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def with_responses(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest (hex SHA-1), refers_to (null for responses). Only digests shuffle, but for rows whose payload is repeated and joins its group."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow = materialize(rows.select("page_id", "digest", F.octet_length("html").alias("size")), "warc-digests")
    groups = narrow.filter(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = attach_groups(rows, materialize(groups, "warc-groups"), "digest", "n", narrow.count())
    return met.select("page_id", "url", "html", "digest", F.when(F.col("first_id") != F.col("page_id"), F.col("first_id")).when(F.col("page_id").isNull(), F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", **cols) -> DataFrame:
    """Write one archive a partition under `path`; returns archive, records, bytes.

    An archive is written under a name of its attempt and then moved into place, so a task that is
    run again leaves one whole archive.
    """
    revisit_bytes, path = cols.pop("revisit_bytes", 0), qualified(pages.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = filesystem(path)
        name = f"part-{task.partitionId():06d}.warc.gz"
        temp, n, size, out = f"{root}/.{name}.{task.taskAttemptId()}", 0, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(temp)
                payload = row["html"].encode()
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                revisit = row["refers_to"] is not None
                target = quote(row["url"] or "", safe=":/?#[]@!$&'()*+,;=%-._~")
                data = record("revisit" if revisit else "response", page_urn(row["page_id"]), target, date, payload, digest, len(payload), page_urn(row["refers_to"]) if revisit else None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            store.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [f"{root}/{name}"], "records": [n], "bytes": [size]})

    return materialize(with_responses(pages, revisit_bytes=revisit_bytes, **cols).mapInArrow(released(write), "archive string, records long, bytes long"), "warc-written")


# ---------------------------------------------------------------- reading


def _inflate(file, start: int, size: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at `start` and the place after it; None if there is no WARC record."""
    z, data, at = zlib.decompressobj(31), [], start
    try:
        while not z.eof:
            file.seek(at)
            raw = file.read(READ)
            if not raw:
                return None
            at += len(raw)
            got = z.decompress(raw)
            if not data and got and not got.startswith(b"WARC/"[: len(got)]):
                return None
            if got:
                data.append(got)
    except zlib.error:
        return None
    data, at = b"".join(data), at - len(z.unused_data)
    if not data.startswith(b"WARC/") or b"\r\n\r\n" not in data:
        return None
    if at < size:
        file.seek(at)
        if file.read(3) != MAGIC:
            return None
    return data, at


def _next_magic(file, start: int, end: int) -> int:
    """The first place in [start, end) with the magic, or end."""
    at = start
    while at < end:
        file.seek(at)
        raw = file.read(min(READ, end - at) + 2)
        k = raw.find(MAGIC)
        if 0 <= k and at + k < end:
            return at + k
        at += READ
    return end


def _headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data.decode("utf-8", "replace").split("\r\n")[1:])}


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, end)."""
    at = _next_magic(file, start, end)
    while at < end:
        found = _inflate(file, at, size)
        if found is None:
            at = _next_magic(file, at + 1, end)
            continue
        data, after = found
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = _headers(head)
        yield at, headers, rest[: int(headers.get("content-length", len(rest)))]
        at = after if after >= end else _next_magic(file, after, end)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE, with_block: bool = True) -> DataFrame:
    """One row per record: archive, offset, record_type, record_id, target, refers_to, payload_digest, payload_bytes, digest_ok, block."""
    path = qualified(spark, path)
    store, root = filesystem(path)
    found = [x for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.is_file and x.base_name.endswith(".warc.gz")]
    ranges = [(f"{root}/{x.base_name}", x.size, a, min(x.size, a + range_bytes)) for x in sorted(found, key=lambda x: x.path) for a in range(0, x.size, range_bytes)]
    schema = "archive string, offset long, record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, block binary"
    arrow = pa.schema([("archive", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in ("record_type", "record_id", "target", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("block", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for archive, size, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with filesystem(path)[0].open_input_file(archive) as file:
                    for offset, h, block in records_in(file, size, start, end):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2]
                        length = re.search(rb"(?i)content-length:\s*(\d+)", http)
                        whole = h.get("warc-type") == "response"
                        ok = (base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest) if whole else None
                        rows.append((archive, offset, h.get("warc-type"), h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"), h.get("warc-refers-to", "").strip("<>") or None, digest, int(length[1]) if length else len(payload), ok, block if with_block else None))
                        held += len(block)
                        if held > 1 << 24 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    table = spark.createDataFrame(ranges, "archive string, size long, start long, end long")
    return table.repartition(max(1, min(len(ranges), 10_000))).mapInArrow(released(read), schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = read_archives(spark, path, with_block=False)
    ok = F.when(F.coalesce(F.col("digest_ok"), F.lit(True)), F.col("payload_digest"))
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", ok.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


#: The SHA-1 as base32, five bits a character, from its hexadecimal form.
OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex FROM p),
e AS (SELECT page_id, payload_bytes, hex,
             array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda c:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(5 * g + 1 AS INT), 5) AS BIGINT) // CAST(pow(32, 3 - c) AS BIGINT)) % 32 AS INT), 1)), '')), '') AS payload_digest,
             min(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM e
"""
