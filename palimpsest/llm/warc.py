"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Writing: each page becomes one HTTP response with chunked transfer framing. Of pages with equal payloads the smallest
page_id is the response and the others are revisit records that carry its headers alone. A block longer than
``segment_bytes`` is split: segment 1 is the response record, the rest are continuation records that name it in
``WARC-Segment-Origin-ID``; the last one carries ``WARC-Segment-Total-Length``. No record is larger than a segment and
no file has more than ``FILE_RECORDS`` of them, so a file's size is bounded (64 MiB at the defaults) and it can be
read as one value. Archives are written and read through Spark's own file systems.

Reading: records are parsed file by file; segments are dealt by origin identifier and sorted by segment number, the
total length is verified, and the chunked framing is decoded. Only blocks of segmented records are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import NULL_ID, real_id, shared_path, shuffle_partitions, small_enough

CRLF = b"\r\n"
FILE_RECORDS = 1000
CHUNK = 8192

_PAGE = re.compile(rb"<urn:page:(\d+):")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload, or None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or at + n + 2 > len(body) or body[at + n : at + n + 2] != CRLF:
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, record_id: str, block: bytes, *headers: tuple[str, str]) -> bytes:
    """Without the two line ends that follow a record: Spark's text writer adds those as its line separator."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2024-01-01T00:00:00Z", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block


def page_records(page_id: int, uid: int, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    record_id = f"<urn:page:{page_id}:{uid}>"
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: {len(payload)}\r\n"
    shared = (("WARC-Payload-Digest", f"sha1:{sha}"),)
    if refers_to is not None:
        yield _record("revisit", record_id, (http + "\r\n").encode(), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:>"), *shared)
        return
    block = (http + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _record("response", record_id, block, *shared)
        return
    yield _record("response", record_id, parts[0], ("WARC-Segment-Number", "1"), *shared)
    for n, part in enumerate(parts[1:], 2):
        more = (("WARC-Segment-Total-Length", str(len(block))),) if n == len(parts) else ()
        yield _record("continuation", f"<urn:page:{page_id}:{uid}:{n}>", part, ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(n)), *more)


def _written(segment_bytes: int):
    def write(batches):
        for batch in batches:
            out: list[bytes] = []
            for page_id, uid, html, refers in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out += page_records(page_id, uid, html, refers, segment_bytes)
                if len(out) >= 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return write


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", revisit_bytes: int = 0, segment_bytes: int = 1 << 16) -> None:
    """Writes the archives. Payloads of fewer than ``revisit_bytes`` bytes are responses all; null html is empty."""
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("page_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where(F.octet_length("html") >= revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = small_enough(first)
    out = rows.join(first, "sha", "left").select("page_id", F.monotonically_increasing_id().alias("uid"), "html", F.when(F.col("refers_to") != F.col("page_id"), F.col("refers_to")).alias("refers_to"))
    records = out.mapInArrow(_written(segment_bytes), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].split(CRLF)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(headers.get(b"content-length", b"0"))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _http(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}, body


FIELDS = ("origin", "segment", "total", "record_type", "refers_to", "payload_bytes", "payload_digest", "block")
_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
_SCHEMA = "origin string, segment int, total long, record_type string, refers_to string, payload_bytes long, payload_digest string, block binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_TYPES)], names=list(FIELDS))


def _done(origin: str, kind: str, refers: str | None, declared: str, block: bytes, payloads: bool) -> tuple:
    """A finished record: its payload is decoded, measured and held against the declared digest."""
    http, body = _http(block)
    if kind == "revisit":
        return origin, 0, None, kind, refers, int(http.get(b"x-payload-length", b"-1")), declared, None
    payload = dechunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    if payload is None or (declared and digest(payload) != declared):
        return origin, 0, None, "broken", None, None, declared, None
    return origin, 0, None, kind, None, len(payload), digest(payload), payload if payloads else None


def _read(payloads: bool):
    def read(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for headers, block in parsed(data):
                    kind, own = headers.get(b"warc-type", b"").decode(), headers.get(b"warc-record-id", b"").decode()
                    declared = headers.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
                    if b"warc-segment-number" in headers:
                        total = headers.get(b"warc-segment-total-length")
                        rows.append((headers.get(b"warc-segment-origin-id", own.encode()).decode(), int(headers[b"warc-segment-number"]), int(total) if total else None, kind, None, None, declared, block))
                    else:
                        refers = headers.get(b"warc-refers-to")
                        rows.append(_done(own, kind, refers.decode() if refers else None, declared, block, payloads))
                yield _batch(rows)

    return read


def _joined(origin: str, segments: list[dict], payloads: bool) -> tuple:
    """Segments of one origin in order; a gap, a repeat or a wrong total length makes the record broken."""
    block = b"".join(s["block"] for s in segments)
    whole = [s["segment"] for s in segments] == list(range(1, len(segments) + 1)) and segments[-1]["total"] == len(block)
    if not whole:
        return origin, 0, None, "broken", None, None, segments[0]["payload_digest"], None
    return _done(origin, segments[0]["record_type"], None, segments[0]["payload_digest"], block, payloads)


def _reassembled(payloads: bool):
    def join(batches):
        held: list[dict] = []
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                if held and held[0]["origin"] != row["origin"]:
                    rows.append(_joined(held[0]["origin"], held, payloads))
                    held = []
                if row["segment"] == 0:
                    rows.append(tuple(row[k] for k in FIELDS))
                else:
                    held.append(row)
            if rows:
                yield _batch(rows)
        if held:
            yield _batch([_joined(held[0]["origin"], held, payloads)])

    return join


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """One row per record, segments joined: origin, record_type, refers_to, payload_bytes, payload_digest, payload.

    A record whose segments don't add up, whose framing is broken or whose payload doesn't match its digest has the
    record_type ``broken`` and no payload. ``payloads`` asks for the payloads themselves, else they are null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    rows = files.mapInArrow(_read(payloads), _SCHEMA)
    rows = rows.repartition(shuffle_partitions(spark), "origin").sortWithinPartitions("origin", "segment")
    return rows.mapInArrow(_reassembled(payloads), _SCHEMA).select("origin", "record_type", "refers_to", "payload_bytes", "payload_digest", F.col("block").alias("payload"))


def round_trip(pages: DataFrame, revisit_bytes: int = 0, segment_bytes: int = 1 << 16) -> DataFrame:
    """Writes the pages as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null page_id comes back as null, an empty table gives no rows, rows that repeat
    the smallest page_id of a payload are responses each, other columns are not looked at.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, revisit_bytes=revisit_bytes, segment_bytes=segment_bytes)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(\d+):", 1).cast("long")
    out = read_archives(spark, path).select(number("origin").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return out.select(real_id("page_id"), "payload_bytes", "payload_digest", "record_type", real_id("refers_to"))
