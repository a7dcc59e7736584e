"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing: equal payloads (by SHA-256, of at least `min_bytes`) share one response, that of
the smallest page_id; the others become revisit records of the identical-payload
kind, whose HTTP headers state the payload's length and which refer to the
response.  Every record is a gzip member of its own.  Each task writes archives
of bounded size into the shared folder under names of its own attempt, and
returns the index: file, offset, length, URL, digest of each record.  Only the
index of attempts that succeeded is kept, so a lost executor costs a rewrite
and leaves at most a file that no index row names.

Reading: index rows that the caller selected are grouped by file and slot of
`SLOT` bytes, sorted by offset, and neighbours at most `GAP` bytes apart are
fetched in one read.

Null html is an empty payload; a null or unprintable URL is written escaped or
as the record's own name; a null page_id is kept and never refers or is
referred to before others.  Rows equal in page_id and payload are the same
page: each is a response if its page_id is the smallest.  Empty input gives an
empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import spread_join
from .textwork import dropped, shared_folder, stored

FILE_BYTES, SLOT, TASK, GAP, LEVEL = 64 << 20, 1 << 20, 4 << 20, 64 << 10, 4
_INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def _name(page: int | None) -> str:
    return f"urn:x-page:{'' if page is None else page}"


def record(page: int | None, url: str | None, payload: bytes, response: tuple[int | None, str | None] | None) -> tuple[bytes, str]:
    """A WARC record and the payload's digest; response: page and URL of the record that a revisit refers to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    safe = lambda u, p: quote(u, safe="!#$%&'()*+,/:;=?@[]~") if u else _name(p)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if response else 'response'}", f"WARC-Record-ID: <{_name(page)}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {safe(url, page)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if response:
        lines += [f"WARC-Refers-To: <{_name(response[0])}>", f"WARC-Refers-To-Target-URI: {safe(response[1], response[0])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(raw: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda x: int(d) if (d := x.strip("<>").rpartition(":")[2]) else None
    refers = fields.get("WARC-Refers-To")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(refers) if refers else None, "payload": payload if kind == "response" else None}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):  # one record at a time: bounded by the longest page
                    page, url, html, dup, first, first_url = (batch.column(c)[i].as_py() for c in range(6))
                    if out is None:
                        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                        out, at = store.open_output_stream(path, compression=None), 0
                    raw, digest = record(page, url, (html or "").encode(), (first, first_url) if dup else None)
                    packed = _gzip(raw)
                    out.write(packed)
                    rows.append((page, path, at, len(packed), url, digest, "revisit" if dup else "response"))
                    at += len(packed)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 7, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["page_id", "file", "offset", "length", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write a record per row; the folder of the archives and their index."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(F.coalesce(html_col, F.lit("")), 256).alias("sha"), F.octet_length(F.coalesce(html_col, F.lit(""))).alias("size"))
    # Only payloads that occur twice or more make a row here; null ids come last.
    known = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    twice = rows.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first", "n")
    payloads = stored(twice, "payloads")
    joined = spread_join(rows, payloads, "sha", "n", payloads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "left")
    dup = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    index = joined.select("page_id", "url", "html", dup.alias("dup"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")).mapInArrow(_writer(folder), _INDEX)
    index = stored(index, "index")
    dropped(spark, payloads)
    return folder, index


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})
        for batch in batches:
            for file, wanted in zip(batch.column("file").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                out = []
                with store.open_input_file(file) as f:
                    for start, end, members in ranges([(x["offset"], x["length"]) for x in wanted]):
                        data = f.read_at(end - start, start)
                        out += [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in members]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in kinds.items()], list(kinds))

    return read


def ranges(wanted: list[tuple[int, int]], gap: int = GAP) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Byte ranges that cover (offset, length) pairs sorted by offset; neighbours at most `gap` apart share one."""
    held: list[tuple[int, int]] = []
    for offset, length in wanted:
        if held and offset - (held[-1][0] + held[-1][1]) > gap:
            yield held[0][0], held[-1][0] + held[-1][1], held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], held[-1][0] + held[-1][1], held


def read_records(folder: str, selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows; a task has `TASK` bytes of archives or a slot."""
    tasks = (selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) // TASK + 1
    slots = selected.groupBy("file", F.expr(f"offset div {SLOT}").alias("slot")).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("wanted")).select("file", "wanted").repartition(int(tasks))
    return slots.mapInArrow(_reader(folder, with_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def query(spark, sf_dir: str) -> DataFrame:
    folder, index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(folder, index, with_payload=False).drop("url")


#: Base32 of a SHA-1 in SQL: eight groups of five digits of hexadecimal, each of four base-32 digits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
