"""WARC archives: writing with revisit records and segments, and reading with reassembly.

Records are rows of one string column that Spark's text sink writes with CRLF as the line end, so
every file of the archive folder is a valid, gzipped WARC/1.1 file; ``maxRecordsPerFile`` times the segment
size bounds a file. Blocks are HTTP responses in chunked transfer framing; a block over
``segment_bytes`` is cut into a first record and continuation records.

Reading parses each file by Content-Length, groups continuation records by the identifier of the
record that they continue, orders them by segment number, holds their count and length against the
last segment's statement of the total, and takes the chunked framing off.

Cases: a null payload is empty; null urls give records without a target; of equal payloads (by
SHA-1) of at least ``min_revisit_bytes`` bytes the one with the smallest id is the response and the
others revisit it; null ids are larger than all others; rows that repeat an id get records of their
own; further columns are ignored; an empty table gives an empty archive. A segmented record whose segments
are missing, or do not add up, comes back with ``complete`` false and a null payload.
"""

from __future__ import annotations

import base64
import gzip
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.session import stored_path

SEGMENT = 16 << 10
CHUNK = 4 << 10
RECORDS_PER_FILE = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_OUT = "origin string, segment int, total long, kind string, page string, refers string, digest string, payload_bytes long, uri string, block binary"


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that end between UTF-8 characters."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload inside chunked framing; extensions and trailers are passed over. Raises ValueError if cut short."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    # the sink's line end is the second CRLF after the block
    return f"{VERSION}\r\n{head}\r\n{block.decode()}\r\n"


def records(page: str, name: str, uri: str | None, payload: bytes, sha1: str, refers: str | None, refers_name: str | None, segment_bytes: int) -> Iterator[str]:
    """The records of one page, without the line end after each."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    me = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    shared = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page), ("X-Payload-Length", str(len(payload)))]
    if uri is not None:
        shared.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri)))
    http = ("Content-Type", "application/http; msgtype=response")
    if refers is not None:
        other = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, refers_name)}>"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), ("WARC-Refers-To", other), ("WARC-Profile", PROFILE), ("X-Refers-Page-Id", refers), *shared, http], _HEAD)
        return
    block = _HEAD + chunked(payload)
    pieces = _cuts(block, segment_bytes)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", me), *shared, http]
    if len(pieces) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", "1")], pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{k}')}>"), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(k)), ("WARC-Date", "2024-01-01T00:00:00Z")]
        if k == len(pieces):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(headers, piece)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT) -> str:
    """Write ``pages`` as WARC files under ``path``; returns ``path``."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("sha1", F.sha1("payload"))
    copy = F.lit(1)
    if base.groupBy("id").count().filter("count > 1").limit(1).count():  # records of their own for rows that share an id
        copy = F.row_number().over(Window.partitionBy("id", "sha1").orderBy(F.lit(0)))
    base = base.withColumn("copy", copy)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("copy")))
    repeated = base.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), least.alias("first")).filter("n > 1").select(F.col("sha1").alias("_sha1"), "first")
    joined = base.join(repeated, F.col("sha1") == F.col("_sha1"), "left")
    again = F.col("first").isNotNull() & ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("copy") == F.col("first.copy")))
    # unique: rows that share an id and a payload are numbered, and what refers to a record has its payload
    name = lambda i, c: F.concat_ws("#", F.coalesce(i.cast("string"), F.lit("null")), "sha1", c.cast("string"))
    rows = joined.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("page"), name(F.col("id"), F.col("copy")).alias("name"), "url", "payload", "sha1",
        F.when(again, F.coalesce(F.col("first.id").cast("string"), F.lit(""))).alias("refers"), F.when(again, name(F.col("first.id"), F.col("first.copy"))).alias("refers_name"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([pa.array([r for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in records(*row, segment_bytes)], pa.string())], ["value"])

    rows.mapInArrow(tokens.trimmed(run), "value string").write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a file."""
    at = 0
    while at < len(content):
        if content.startswith(b"\r\n", at):
            at += 2
            continue
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        if end + 4 + size > len(content):
            raise ValueError("the last record is cut short")
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page, kind, refers, digest, payload_bytes, uri, payload, complete) of each whole record under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("uri", pa.string()), ("block", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column(0):
                rows = []
                data = content.as_py()
                for h, block in parse(gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data):
                    origin = h.get("warc-segment-origin-id") or h.get("warc-record-id")
                    rows.append((origin, number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), h.get("warc-type"), h.get("x-page-id"), h.get("x-refers-page-id"), h.get("warc-payload-digest", "").removeprefix("sha1:"), number(h.get("x-payload-length")), h.get("warc-target-uri"), block))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parsed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(tokens.trimmed(run), _OUT)
    return payloads(reassembled(parsed))


def reassembled(parsed: DataFrame) -> DataFrame:
    """One row for each record: those without segment numbers pass; the others' segments are grouped and checked.

    A group is one record's segments, so a record's own size bounds it.
    """
    whole = parsed.filter(F.col("segment").isNull())
    parts = parsed.filter(F.col("segment").isNotNull())
    once = {c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "page", "refers", "digest", "payload_bytes", "uri")}
    grouped = parts.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("all"), F.max("total").alias("total"), *once.values())
    size = F.aggregate("all", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["block"]))
    numbers = F.transform("all", lambda s: s["segment"])
    good = (numbers == F.sequence(F.lit(1), F.size("all"))) & (size == F.col("total"))
    blocks = F.transform("all", lambda s: s["block"])
    joined = grouped.select("kind", "page", "refers", "digest", "payload_bytes", "uri", F.when(good, blocks).alias("blocks"), F.coalesce(good, F.lit(False)).alias("complete"))
    return whole.select("kind", "page", "refers", "digest", "payload_bytes", "uri", F.array("block").alias("blocks"), F.lit(True).alias("complete")).unionByName(joined)


def payloads(rows: DataFrame) -> DataFrame:
    """Joins the segments' blocks and takes the HTTP head and the chunked framing off; a revisit has no payload of its own."""
    rest = ["page", "kind", "refers", "digest", "payload_bytes", "uri", "complete"]

    def body(kind: str | None, blocks: list[bytes] | None) -> bytes | None:
        if blocks is None or kind == "revisit":
            return None
        head, _, rest = b"".join(blocks).partition(b"\r\n\r\n")
        return dechunked(rest) if b"\r\ntransfer-encoding: chunked" in head.lower() else rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [body(k.as_py(), b.as_py()) for k, b in zip(batch.column(1), batch.column(len(rest)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(out, pa.binary())], [*rest, "payload"])

    return rows.select(*rest, "blocks").mapInArrow(tokens.trimmed(run), "page string, kind string, refers string, digest string, payload_bytes long, uri string, complete boolean, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and digest what was read.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. Of a response both
    figures come from the payload as reassembled; a record that did not come back whole fails the job.
    """
    spark = pages.sparkSession
    path = write(pages, stored_path(spark, "warc"), id_col, url_col, payload_col, min_revisit_bytes)
    kind = pages.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            page, kinds, refers, digest, size, whole, payload = (c.to_pylist() for c in batch.columns)
            for i, data in enumerate(payload):
                if not whole[i]:
                    raise ValueError(f"the record of page {page[i]} is not whole")
                if data is not None:
                    size[i], digest[i] = len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.string()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.string())], ["page", "payload_bytes", "payload_digest", "record_type", "refers"])

    back = read(spark, path).select("page", "kind", "refers", "digest", "payload_bytes", "complete", "payload").mapInArrow(tokens.trimmed(run), "page string, payload_bytes long, payload_digest string, record_type string, refers string")
    return back.select(F.expr("nullif(page, '')").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("nullif(refers, '')").cast(kind).alias("refers_to"))
