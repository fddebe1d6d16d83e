"""WARC archives with an index first (operator 9).

Writing: records go to gzip members in files of about FILE bytes below a folder that driver and
executors share. Each attempt of a task writes files of its own name, and only what a finished
attempt returns enters the index, so a lost executor leaves an unreferenced file at worst. Payloads
that occur more than once are stored once: the record with the largest id is the response, the
others revisit it. Which record that is gets known by hash before any payload moves: the digests that
repeat are broadcast where they are few, else those of over HOT records are, and payloads are joined with the rest
by shuffle. The index has file, offset, length, URL and digest per record.

Reading: the selected index rows are grouped by file, sorted by offset, and ranges whose gap is
small are read in one piece of at most PIECE bytes (longer records by themselves).

Edge cases: a null payload is an empty one; a null URL is written as an empty one; rows that repeat
an id and payload are all responses if it is the largest; line feeds in a URL are percent-encoded;
payloads of any length are whole; empty tables give an empty index; other columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import fresh, stored

FILE, PIECE, GAP = 64 << 20, 8 << 20, 64 << 10
#: So many repeated digests (100 bytes each) are broadcast at most; more are joined by shuffle, but for those of over HOT records.
BROADCAST_ROWS, HOT = 300_000, 10_000
#: Names of a scheme that the Arrow file systems know by another.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://"}
VERSION, DATE = "WARC/1.1", "2000-01-01T00:00:00Z"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str, str]:
    """The bytes of a record, its digest and its type."""
    digest = digest_of(payload)
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest, kind


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length does not fit")
    return fields, rest[:size]


def _store(uri: str):
    from pyarrow import fs

    for hadoop, arrow in SCHEMES.items():
        uri = uri.replace(hadoop, arrow, 1) if uri.startswith(hadoop) else uri
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The index of the archives that it writes."""
    folder = fresh(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    ids = rows.select("page_id", "sha")
    copies = stored(ids.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"), "warc-copies")
    if copies.count() <= BROADCAST_ROWS:
        named = rows.join(F.broadcast(copies.select("sha", "last")), "sha", "left")
    else:
        total = copies.agg(F.sum("n")).first()[0]
        often = F.col("n") > max(HOT, total // BROADCAST_ROWS)  # of those there are BROADCAST_ROWS at most
        hot = rows.join(F.broadcast(copies.where(often).select("sha", F.struct("last").alias("hot"))), "sha", "left")
        others = hot.where("hot is null").join(copies.where(~often).select("sha", "last"), "sha", "left")
        named = hot.where("hot is not null").withColumn("last", F.col("hot.last")).unionByName(others).drop("hot")
    joined = named.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("last")), None).otherwise(F.col("last")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page, target, text, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    data, digest, kind = record(page.as_py(), target.as_py(), text.as_py().encode(), refers.as_py())
                    if out is None or at >= FILE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)  # members are compressed one by one
                    member = gzip.compress(data, 6, mtime=0)
                    out.write(member)
                    index.append((page.as_py(), name, at, len(member), target.as_py(), digest, kind))
                    at += len(member)
                columns = list(zip(*index, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return stored(joined.mapInArrow(run, INDEX), "warc-index").withColumn("folder", F.lit(folder))


def ranges(rows: list[tuple[int, int]], gap: int = GAP, piece: int = PIECE) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) as reads: start, end and the numbers of the rows inside."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - out[-1][1] <= gap and max(out[-1][1], offset + length) - out[-1][0] <= piece:
            start, end, inside = out[-1]
            out[-1] = (start, max(end, offset + length), [*inside, i])
        else:
            out.append((offset, offset + length, [i]))
    return out


def read(index: DataFrame, payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of the index rows."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def number(urn: str | None) -> int | None:
        value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    def fetched(folder: str, file: str, rows: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        with store.open_input_file(f"{base}/{file}") as source:
            for start, end, inside in ranges(rows):
                data = source.read_at(end - start, start)
                out = []
                for i in inside:
                    offset, length = rows[i]
                    fields, body = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and digest_of(body) != digest:
                        raise ValueError(f"{file} is damaged at {offset}")
                    out.append((number(fields["warc-record-id"]), fields["warc-target-uri"], int(fields["x-payload-length"]), digest, fields["warc-type"], number(fields.get("warc-refers-to"))) + ((body,) if payload else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for folder, file, _, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (folder, file) != now or len(rows) >= 20_000:
                    if rows:
                        yield from fetched(*now, rows)
                    now, rows = (folder, file), []
                rows.append((offset, length))
        if rows:
            yield from fetched(*now, rows)

    # pieces of a file go to tasks of their own, as many as the bytes to read ask for; ranges within a piece lie side by side
    picked = index.select("folder", "file", F.expr(f"offset div {PIECE}").alias("piece"), "offset", "length")
    size = picked.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, min(-(-size // (1 << 20)), 64), -(-size // FILE))
    return picked.repartition(tasks, "file", "piece").sortWithinPartitions("file", "offset").mapInArrow(run, schema)
