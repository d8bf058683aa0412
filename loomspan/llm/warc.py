"""7. WARC segment reassembly.

``reassemble`` takes raw WARC records. Records of type ``response`` with a
segment number open a series, those of type ``continuation`` go on with it and
name its first record as their origin; records without a segment number are
whole. The records of an origin are brought together in order of their numbers
and streamed: the blocks are concatenated, their length is held against the
total length that the last record gives, and the HTTP message is split into
head and body and freed of chunked transfer framing.

``records_of_files`` cuts WARC files, plain or gzipped record by record, into
raw records. ``segment`` is the opposite, used to make records of ``pages``; a
page's origin has its id, of any type, and a hash of its content, so that pages
which share an id stay apart.

Defined cases, in ``status``: ``ok``; ``missing`` (a number is absent, or the
last record with the total length is); ``conflict`` (a number comes twice with
different blocks; equal repetitions count once); ``length`` (the blocks don't
add up to the total); ``framing`` (chunked framing is broken, or something else
than trailer fields follows the last chunk). Unless the status is ``ok`` the
body is null. Null or unreadable records are dropped. A body that isn't UTF-8 is
given with replacement characters. Null page texts make no record; a null url
makes a record without one; null page ids come back as nulls. Pages equal in id,
url and text give equal records, which count once. Empty table: no rows.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import shipped

CHUNK_BYTES = 1000
SEGMENT_BYTES = 1024
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_RECORD = "origin string, number int, total long, url string, block binary"
_BATCH_ROWS = 4000


#: Fields after the last chunk, if any, and an empty line.
_TRAILER = re.compile(rb"(?:[!#$%&'*+\-.^_`|~0-9A-Za-z]+:[^\r\n]*\r\n)*\r\n")


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(body), size):
        piece = body[at : at + size]
        parts.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(framed: bytes) -> bytes | None:
    """The body, or null if the framing is broken. Extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        digits = framed[at:line].split(b";", 1)[0].strip() if line >= 0 else b""
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None
        size, at = int(digits, 16), line + 2
        if size == 0:
            return b"".join(parts) if _TRAILER.fullmatch(framed, at) else None
        if framed[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(framed[at : at + size])
        at += size + 2


def records_of(page_id, url: str | None, html: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """A page as the raw records of a segmented response."""
    message = HEAD + chunked(html.encode())
    digest = xxhash.xxh3_128_hexdigest(repr((url, html)).encode("utf-8", "surrogatepass"))
    name = "" if page_id is None else "id:" + quote(str(page_id), safe="-")
    origin = f"<urn:page:{digest}:{name}>"
    pieces = [message[at : at + segment_bytes] for at in range(0, len(message), segment_bytes)]
    out = []
    for number, piece in enumerate(pieces, 1):
        head = ["WARC/1.1", f"WARC-Type: {'response' if number == 1 else 'continuation'}"]
        head.append(f"WARC-Record-ID: {origin if number == 1 else f'{origin[:-1]}:{number}>'}")
        if number > 1:
            head.append(f"WARC-Segment-Origin-ID: {origin}")
        if url is not None:
            head.append(f"WARC-Target-URI: {url}")
        head.append(f"WARC-Segment-Number: {number}")
        if number == len(pieces):
            head.append(f"WARC-Segment-Total-Length: {len(message)}")
        head.append(f"Content-Length: {len(piece)}")
        out.append("\r\n".join(head).encode() + b"\r\n\r\n" + piece + b"\r\n\r\n")
    return out


def segment(pages: DataFrame) -> DataFrame:
    """``record``: the raw WARC records of a table of ``page_id``, ``url``, ``html``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if html is not None:
                    out += records_of(page, url, html)
                if len(out) > _BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return shipped(pages).select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(kernel, "record binary")


def split_records(data: bytes) -> list[bytes]:
    """The raw records of a WARC file; of a broken file those before the break."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)  # of all members
        except (EOFError, OSError, zlib.error):
            return []
    out, at = [], 0
    while (begin := data.find(b"WARC/", at)) >= 0:
        split = data.find(b"\r\n\r\n", begin)
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", data[begin : split + 2]) if split >= 0 else None
        if length is None or split + 4 + int(length[1]) > len(data):
            break
        at = split + 4 + int(length[1])
        out.append(data[begin:at])
    return out


def records_of_files(files: DataFrame) -> DataFrame:
    """``record`` of a table of files with ``content``, as the reader of binary files gives it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                found = split_records(value.as_py()) if value.is_valid else []
                for at in range(0, len(found), _BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at : at + _BATCH_ROWS], pa.binary())], names=["record"])

    return shipped(files).select(F.col("content").cast("binary")).mapInArrow(kernel, "record binary")


def parse(record: bytes) -> tuple | None:
    """(origin, number, total, url, block) of a raw record; null if unreadable or of another type."""
    split = record.find(b"\r\n\r\n")
    if split < 0 or not record.startswith(b"WARC/"):
        return None
    fields: dict[str, str] = {}
    for line in record[:split].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type", "").lower()
    origin = fields.get("warc-record-id") if kind == "response" else fields.get("warc-segment-origin-id")
    try:
        length = int(fields["content-length"])
        number = int(fields.get("warc-segment-number", 0 if kind == "response" else -1))
        total = int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None
    except (KeyError, ValueError):
        return None
    block = record[split + 4 : split + 4 + length]
    if kind not in ("response", "continuation") or origin is None or number < 0 or len(block) != length:
        return None
    return origin, number, total, fields.get("warc-target-uri"), block


def _parse_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        found = [p for p in (parse(r) for r in batch.column(0).to_pylist() if r is not None) if p is not None]
        columns = list(zip(*found)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["origin", "number", "total", "url", "block"])


def assemble(parts: list[tuple]) -> tuple:
    """(url, status, segments, total, body) of an origin's (number, total, url, block), sorted by number."""
    url = next((p[2] for p in parts if p[2] is not None), None)
    totals = {p[1] for p in parts if p[1] is not None}
    total = max(totals) if totals else None
    blocks: dict[int, bytes] = {}
    status = "ok"
    for number, _, _, block in parts:
        if blocks.setdefault(number, block) != block:
            status = "conflict"
    numbers = sorted(blocks)
    whole = numbers == [0]
    if status == "ok" and not whole and (numbers != list(range(1, len(numbers) + 1)) or total is None):
        status = "missing"
    message = b"".join(blocks[n] for n in numbers)
    if status == "ok" and (len(totals) > 1 or (total is not None and len(message) != total)):
        status = "length"
    body = None
    if status == "ok":
        head, _, rest = message.partition(b"\r\n\r\n")
        framed = any(line.lower().replace(b" ", b"").startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n"))
        body = dechunk(rest) if framed else rest
        if body is None:
            status = "framing"
    return url, status, len(numbers), total if total is not None else len(message), body


def _assemble_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by origin and number."""
    schema = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    names = ["origin", "url", "status", "n_segments", "total_length", "body"]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, schema)], names=names)

    def done(origin: str, parts: list[tuple]) -> tuple:
        url, status, count, total, body = assemble(parts)
        return origin, url, status, count, total, None if body is None else body.decode("utf-8", "replace")

    current, parts = None, []
    for batch in batches:
        out: list[tuple] = []
        for origin, *part in zip(*(c.to_pylist() for c in batch.columns)):
            if origin != current:
                if parts:
                    out.append(done(current, parts))
                current, parts = origin, []
            parts.append(tuple(part))
        yield rows(out)
    yield rows([done(current, parts)] if parts else [])


def reassemble(records: DataFrame) -> DataFrame:
    """``origin``, ``url``, ``status``, ``n_segments``, ``total_length``, ``body`` of each origin."""
    parsed = shipped(records).select(F.col("record").cast("binary")).mapInArrow(_parse_kernel, _RECORD)
    together = parsed.repartition("origin").sortWithinPartitions("origin", "number")
    return together.mapInArrow(_assemble_kernel, "origin string, url string, status string, n_segments int, total_length long, body string")


def reassembled_pages(pages: DataFrame) -> DataFrame:
    """The pages, cut into records and put together again."""
    found = reassemble(segment(pages))
    text = F.url_decode(F.regexp_extract("origin", r"^<urn:page:[0-9a-f]+:id:(.*)>$", 1))
    return found.select(
        F.when(F.col("origin").contains(":id:"), text).cast(pages.schema["page_id"].dataType).alias("page_id"),
        "url",
        "status",
        "n_segments",
        "total_length",
        F.octet_length("body").cast("long").alias("n_bytes"),
        F.col("body").alias("html"),
    )
