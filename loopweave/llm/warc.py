"""WARC archives: write captures, read records, assemble transactions.

A capture is three records of one file: ``response`` (or ``revisit``, where
another record holds the same payload), ``request`` and ``metadata``. The last
two name the first in WARC-Concurrent-To. Every record is a gzip member of its
own. Reading gives one row per record; ``assemble`` joins the rows of a capture
through their concurrent-to identifiers, in whichever direction they point, and
from whichever files. A revisit names its response by the payload digest
(profile identical-payload-digest).

Only files of committed tasks count: a task writes under a name of its own and
returns it, and the manifest of those names is what readers get.

Defined cases: a null html is an empty payload; a null url gives no target URI; a
url that a header can't hold is escaped there and kept whole in the metadata;
rows that repeat are captures of their own; of equal payloads all rows with the
largest page_id are responses; a null page_id is smaller than any other; with no
id at all, all are responses; a capture without request or metadata has nulls there.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.naming import unique_name
from loopweave.session import scratch_path, staged
from loopweave.sources.stores import store

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3  # of compression

_UNSAFE = re.compile(r"[^\x21-\x7E]")

RECORD = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    ("target_uri", pa.string()), ("date", pa.string()), ("digest", pa.string()),
    ("length", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())),
    ("payload", pa.binary()), ("file", pa.string())])
RECORD_DDL = ("record_id string, type string, concurrent_to array<string>, target_uri string, "
              "date string, digest string, length long, fields map<string,string>, "
              "payload binary, file string")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers],
             f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress(raw) + packer.flush()


def capture(page_id: int | None, url: str | None, html: str | None, revisit: bool,
            date: str) -> bytes:
    """The three records of one page."""
    payload = (html or "").encode()
    main = _record_id()
    target = [] if url is None else [("WARC-Target-URI", _UNSAFE.sub(
        lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))]
    common = [("WARC-Date", date), *target]
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    first = _record("revisit" if revisit else "response", [
        ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        *([("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload)
    host, _, path = (target[0][1] if target else "").partition("://")[2].partition("/")
    asked = _record("request", [
        ("WARC-Record-ID", _record_id()), *common, ("WARC-Concurrent-To", main),
        ("Content-Type", "application/http; msgtype=request")],
        f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    fields = {"page-id": page_id, "url": url}
    about = _record("metadata", [
        ("WARC-Record-ID", _record_id()), *common, ("WARC-Concurrent-To", main),
        ("Content-Type", "application/warc-fields")],
        "".join(f"{k}: {json.dumps(v)}\r\n" for k, v in fields.items() if v is not None).encode())
    return first + asked + about


def parse(stream: IO[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of every record, one at a time in memory."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield headers, block


def _lines(block: bytes) -> list[tuple[str, str]]:
    out = []
    for line in block.decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if colon:
            out.append((name.strip().lower(), value.strip()))
    return out


def _row(headers: dict[str, list[str]], block: bytes, file: str, payloads: bool) -> tuple:
    one = {k: v[0] for k, v in headers.items()}
    kind, digest, length, payload, fields = one.get("warc-type"), None, None, None, []
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        fields = _lines(head)
        digest = one.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            found = payload_digest(body)
            if digest not in (None, found):
                raise ValueError(f"payload of {one.get('warc-record-id')} is damaged")
            digest, length, payload = found, len(body), body if payloads else None
    elif kind == "metadata":
        fields = _lines(block)
    elif kind == "request":
        fields = _lines(block.partition(b"\r\n\r\n")[0])
    return (one.get("warc-record-id"), kind, headers.get("warc-concurrent-to", []),
            one.get("warc-target-uri"), one.get("warc-date"), digest, length,
            list(dict(fields).items()), payload, file)


def write_captures(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                   html: str = "html", least_bytes: int = 0,
                   path: str | None = None) -> DataFrame:
    """Write all pages as archives below ``path``; returns the manifest (file, records).

    Of equal payloads of at least ``least_bytes``, the one of the largest page is written.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "llm-warc")
    content = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        content.alias("html"), F.sha1(content.cast("binary")).alias("sha"))
    large = rows.filter(F.octet_length("html") >= least_bytes)
    # Only payloads that repeat; an aggregate, so copies combine before the shuffle.
    repeated = staged(large.groupBy("sha").agg(F.max("page_id").alias("kept"), F.count("*").alias(
        "n")).filter("n > 1 and kept is not null").select("sha", "kept"), "repeated")
    judged = rows.join(repeated, "sha", "left").select(
        "page_id", "url", "html",
        (F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))).alias("revisit"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(path)
        out, name, records = None, None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(folder, recursive=True)
                name = unique_name("captures", ".warc.gz")
                out = files.open_output_stream(f"{folder}/{name}", compression=None,
                                               buffer_size=1 << 20)
            for at in range(batch.num_rows):
                out.write(capture(*(batch.column(c)[at].as_py() for c in range(4)), date))
                records += 3
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([records], pa.int64())], names=["file", "records"])

    manifest = staged(judged.mapInArrow(write, "file string, records long"), "manifest")
    manifest.records_at = path
    return manifest


def read_records(manifest: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the listed files, gzipped or not; payload digests are checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{folder}/{name}") as raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    rows, size = [], 0
                    for headers, block in parse(gzip.GzipFile(fileobj=raw) if packed else raw):
                        rows.append(_row(headers, block, name, payloads))
                        size += len(block) if payloads else 0
                        if len(rows) == 4096 or size > 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    return manifest.select("file").mapInArrow(read, RECORD_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(RECORD)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, RECORD)], schema=RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, its request, its metadata.

    Where several requests or metadata records belong to a capture, the one with
    the least identifier counts.
    """
    main = records.filter(F.col("type").isin("response", "revisit"))
    others = records.filter(F.col("type").isin("request", "metadata")).select(
        "record_id", "type", "target_uri", "fields", "concurrent_to")
    forward = others.select(F.explode("concurrent_to").alias("capture"), "record_id", "type",
                            "target_uri", "fields")
    backward = (main.select(F.col("record_id").alias("capture"),
                            F.explode("concurrent_to").alias("record_id"))
                .join(others.drop("concurrent_to"), "record_id")
                .select("capture", "record_id", "type", "target_uri", "fields"))
    linked = forward.unionByName(backward)

    def part(kind: str) -> DataFrame:
        return (linked.filter(F.col("type") == kind).groupBy("capture").agg(F.min(F.struct(
            "record_id", "target_uri", F.map_entries("fields").alias("entries"))).alias("x"))
            .select(F.col("capture").alias("record_id"), F.struct(
                "x.record_id", "x.target_uri",
                F.map_from_entries("x.entries").alias("fields")).alias(kind)))

    return (main.join(part("request"), "record_id", "left")
            .join(part("metadata"), "record_id", "left")
            .select(F.struct("record_id", "type", "target_uri", "date", "digest", "length",
                             "fields", "payload", "file").alias("response"),
                    "request", "metadata"))


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, read back, assemble, and resolve revisits: one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    manifest = write_captures(pages, least_bytes=least_bytes)
    records = staged(read_records(manifest, manifest.records_at, payloads=False), "records")
    rows = assemble(records).select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.length").alias("length"))
    rows = staged(rows, "captures")
    held = rows.filter("record_type = 'response'").groupBy("payload_digest").agg(
        F.max("page_id").alias("holder"), F.max("length").alias("held"))
    again = rows.filter("record_type = 'revisit'").join(held, "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (rows.filter("record_type = 'response'")
            .select("page_id", F.col("length").alias("payload_bytes"), "payload_digest",
                    "record_type", F.lit(None).cast("long").alias("refers_to"))
            .unionByName(again.select("page_id", F.col("held").alias("payload_bytes"),
                                      "payload_digest", "record_type",
                                      F.col("holder").alias("refers_to"))).select(*columns))
