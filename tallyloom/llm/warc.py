"""WARC archives: written with segmentation and revisits, read back by segment reassembly.

Writing. Each page is one record: an HTTP response whose body has chunked transfer framing. A block over
``segment_chars`` code points is cut into a first record and continuation records. Of pages with equal payloads the
smallest page is the response and others are revisit records that name it. Files are Spark text output whose line
separator is the last byte of the record's end, so any file system that Spark writes to will do.

Reading. Files are parsed by their lengths. Whole records are decoded where they are read. Segmented ones are
grouped by origin record, put in order of segment number, checked for gaps and for the total length, and then
decoded: chunk by chunk, each with its stated size. A record that fails a check has ``ok`` false and no payload.

Only segments are exchanged, grouped by record: a group is one page. Files hold ``records_per_file`` records at most, which bounds what a reader
holds in memory together with the length of a page.

Defined results. Null html is an empty payload. A null page id takes part in comparisons as equal payloads but is never
the one that others refer to, unless none has an id; then all are responses. Repeated rows with the smallest id are all responses. Line
breaks in a URL become spaces; a null URL is left out. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WorkArea
from .wordhash import slices

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_CHUNK = 4096
_FEW = 10_000  # copies' digests up to this count are broadcast: under 1 MB


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(text: str) -> str:
    """A body with chunked transfer framing; chunks end between code points."""
    out = []
    for at in range(0, len(text), _CHUNK):
        part = text[at : at + _CHUNK]
        out.append(f"{len(part.encode()):x}\r\n{part}\r\n")
    return "".join(out) + "0\r\n\r\n"


def unchunk(body: bytes) -> bytes | None:
    """The payload of a chunked body, or null if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: str) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n"


def page_records(row: int, page: int | None, url: str | None, html: str, refers: int | None, segment_chars: int) -> Iterator[str]:
    """The records of one page."""
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row))}>"
    digest = "sha1:" + payload_digest(html.encode())
    common: list[tuple[str, object]] = [("WARC-Date", DATE), ("WARC-Target-URI", url and " ".join(url.splitlines()))]
    if refers is not None:
        more = [("WARC-Profile", _PROFILE), ("Page-Id", page), ("Refers-To-Page-Id", refers)]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", digest), *more], _HTTP)
        return
    block = _HTTP + chunked(html)
    parts = [block[at : at + segment_chars] for at in range(0, len(block), segment_chars)]
    head = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"), ("Page-Id", page)]
    yield _record([*head, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}/{k}')}>"
        total = len(block.encode()) if k == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part)


def write_archive(
    pages: DataFrame, path: str, area: WorkArea, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_chars: int = 16384, records_per_file: int = 4000, least_bytes: int = 0
) -> None:
    """Write gzipped archives under ``path``. Payloads of ``least_bytes`` or more are stored once."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("sha1"))
    sizes = named.where(F.octet_length("html") >= least_bytes)
    copies = area.table(sizes.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first"), "copies")
    few = copies.count() <= _FEW
    marked = named.join(F.broadcast(copies) if few else copies, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = marked.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                columns = (c.to_pylist() for c in piece.columns)
                out = [r[:-1] for row in zip(*columns, strict=True) for r in page_records(*row, segment_chars)]  # the writer adds the last byte
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.mapInArrow(run, "value string").write.mode("overwrite").option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION, at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = end + 4
        at = start + int(headers["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, data[start:at]
        at += 4


def _payload(block: bytes) -> bytes | None:
    _, mark, body = block.partition(b"\r\n\r\n")
    return unchunk(body) if mark else None


_FOUND = pa.schema([("kind", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("block", pa.binary()), ("payload", pa.binary()), ("bytes", pa.int64()), ("found", pa.string())])
_FOUND_SQL = "kind string, origin string, segment int, total long, page_id long, refers_to long, url string, digest string, block binary, payload binary, bytes long, found string"


def _number(text: str | None) -> int | None:
    return int(text) if text is not None else None


def _row(kind, h, block: bytes | None, payload: bytes | None, keep: bool) -> tuple:
    origin = h.get("warc-segment-origin-id", h.get("warc-record-id"))
    digest = (h.get("warc-payload-digest") or "").partition(":")[2] or None
    known = payload is not None
    return (
        kind, origin, _number(h.get("warc-segment-number")), _number(h.get("warc-segment-total-length")), _number(h.get("page-id")), _number(h.get("refers-to-page-id")), h.get("warc-target-uri"), digest,
        block, payload if keep else None, len(payload) if known else None, payload_digest(payload) if known else None,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def read_archive(spark: SparkSession, path: str, area: WorkArea, payloads: bool = True) -> DataFrame:
    """One row for each page: ``page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, ok``.

    A revisit has its response's payload if ``payloads``. Digests and lengths are computed from what was read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                raw = data.as_py()
                for h, block in parse(zlib.decompress(raw, 47) if raw[:2] == b"\x1f\x8b" else raw):
                    kind = h["warc-type"]
                    if kind == "revisit":
                        rows.append(_row(kind, h, None, None, False))
                    elif "warc-segment-number" in h:
                        rows.append(_row(kind, h, block, None, False))
                    elif kind == "response":
                        rows.append(_row(kind, h, None, _payload(block), payloads))
                    size += len(block)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = area.table(files.mapInArrow(scan, _FOUND_SQL), "found")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, head, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = sorted(parts, key=lambda p: p["segment"])
                whole = b"".join(p["block"] for p in parts)
                good = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(whole)
                payload = _payload(whole) if good else None
                head = head or {}
                rows.append(("response", origin, None, None, head.get("page_id"), None, head.get("url"), head.get("digest"), None, payload if payloads else None, None if payload is None else len(payload), None if payload is None else payload_digest(payload)))
            if rows:
                yield _batch(rows)

    segments = found.where("segment is not null").groupBy("origin").agg(
        F.first(F.when(F.col("segment") == 1, F.struct("page_id", "url", "digest")), ignorenulls=True).alias("head"),
        F.collect_list(F.struct("segment", "total", "block")).alias("parts"),  # one record's
    )
    responses = found.where("kind = 'response' and segment is null").unionByName(segments.mapInArrow(join, _FOUND_SQL))
    ok = F.coalesce(F.col("digest") == F.col("found"), F.lit(False))
    responses = responses.withColumn("ok", ok)
    revisits = found.where("kind = 'revisit'").select("page_id", "url", "refers_to", "digest")
    # A response that others refer to: by page and payload, as repeated rows of a page may differ; equal payloads are one, so any one serves.
    wanted = revisits.select(F.col("refers_to").alias("page_id"), F.col("digest").alias("found")).distinct()
    named = responses.where("page_id is not null").join(wanted, ["page_id", "found"], "left_semi")
    named = named.groupBy("page_id", "found").agg(F.first(F.struct("payload", "bytes")).alias("r"), F.max("ok").alias("r_ok"))
    named = named.select(F.col("page_id").alias("refers_to"), F.col("found").alias("digest"), F.col("r.payload").alias("r_payload"), F.col("r.bytes").alias("r_bytes"), F.col("found").alias("r_found"), "r_ok")
    back = revisits.join(named, ["refers_to", "digest"], "left").select(
        "page_id", "url", F.lit("revisit").alias("record_type"), "refers_to", F.col("r_payload").alias("payload"), F.col("r_bytes").alias("payload_bytes"), F.col("r_found").alias("payload_digest"),
        F.coalesce("r_ok", F.lit(False)).alias("ok"),
    )
    own = responses.select("page_id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload", F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest"), "ok")
    return own.unionByName(back)
