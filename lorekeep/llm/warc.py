"""WARC archives: written through Spark's own writer, read back with segment reassembly and chunk decoding.

Writing: equal payloads are stored once, as a ``response``; the others are ``revisit`` records.  A block longer than
``segment_bytes`` goes on in ``continuation`` records.  Records are rows of bytes whose separator is WARC's own, so
the text writer makes the files, in any store Spark writes to, and maxRecordsPerFile bounds their size.

Reading: files come as bytes of bounded size.  Unsegmented records are decoded where they are read.  Segments are
grouped by origin id over all files, ordered by number, checked against the total length, and then decoded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.plans.store import fresh_path, materialize

END = "\r\n\r\n"
SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 16_384, 4_096, 2_000
MIN_REVISIT_BYTES = 1_000
DATE = "2024-01-01T00:00:00Z"
BROADCAST_BYTES = 64 << 20


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are ignored.  ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of HTTP headers")
    coding = [x.partition(b":")[2].strip().lower() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"transfer-encoding:")]
    return dechunked(body) if coding and coding[-1] == b"chunked" else body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode("utf-8", "surrogatepass") + block


def _records(batches: Iterator[pa.RecordBatch], segment_bytes: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            payload = r["payload"] or b""
            own = f"<urn:lorekeep:page:{r['page_id']}:{r['row']}>"
            url = "".join(r["url"].split()) if r["url"] else None
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
            common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{r['digest']}")]
            kind = ("Content-Type", "application/http; msgtype=response")
            if r["refers_to"] is not None:
                profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                out.append(_record([("WARC-Type", "revisit"), *common, profile, ("WARC-Refers-To", f"<urn:lorekeep:page:{r['refers_to']}>"), kind], http))
                continue
            block = http + chunked(payload, chunk_bytes)
            parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
            first = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
            out.append(_record([("WARC-Type", "response"), *common, first, kind], parts[0]))
            for k, part in enumerate(parts[1:], 2):
                total = ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)
                out.append(_record([
                    ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own),
                    ("WARC-Segment-Number", k), total], part))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE, min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """Write one record (and its continuations) per row of ``pages`` as gzipped WARC files in the folder ``path``.

    The payload is ``html`` in UTF-8, empty for null.  Of equal payloads of ``min_revisit_bytes`` or more, the record
    with the greatest id is the response and all others revisit it; rows that repeat that id are responses too, and rows
    with a null id always are.  A null url leaves the target out.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    equal = rows.where((F.col("size") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "size")
    equal = materialize(equal.agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("top <> low").select("digest", "size", "top"), "equal")
    if equal.count() * 160 <= BROADCAST_BYTES:  # beyond that the pages are shuffled by digest
        equal = F.broadcast(equal)
    rows = rows.join(equal, ["digest", "size"], "left")
    refers = F.when(F.col("top") != F.col("page_id"), F.col("top"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), F.monotonically_increasing_id().alias("row"))
    records = rows.mapInArrow(lambda b: _records(b, segment_bytes, chunk_bytes), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a file's bytes, gzipped (in any number of members) or plain."""
    buffer, rest = bytearray(), data

    def more() -> bool:
        nonlocal rest, unzip
        if unzip is None or not rest:
            return False
        buffer.extend(unzip.decompress(rest, 1 << 20))
        rest = unzip.unconsumed_tail
        if unzip.eof:
            rest = unzip.unused_data
            unzip = zlib.decompressobj(31)
        return True

    unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
    if unzip is None:
        buffer.extend(data)
    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if buffer.strip():
                raise ValueError("a record is cut short")
            return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        while len(buffer) < end + 4 + size + 4 and more():
            pass
        if len(buffer) < end + 4 + size:
            raise ValueError("a block is cut short")
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]
        yield headers, block


_ROW = pa.schema([
    ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()),
    ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])
_ROW_SQL = "origin string, number int, total bigint, type string, uri string, digest string, refers_to string, payload_bytes bigint, payload_digest string, data binary"


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for h, block in parse_records(content.as_py()):
                number, kind = h.get("warc-segment-number"), h["warc-type"]
                row = dict.fromkeys(_ROW.names) | {
                    "origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "number": int(number or 0), "type": kind, "uri": h.get("warc-target-uri"),
                    "digest": h.get("warc-payload-digest", "").rpartition(":")[2] or None, "refers_to": h.get("warc-refers-to"),
                    "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None}
                if number is not None:
                    row["data"] = block
                elif kind == "response":
                    payload = http_payload(block)
                    row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "data": payload if with_payload else None}
                rows.append(row)
                held += len(row["data"] or b"") + 300
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ROW)


def _assemble(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            parts = sorted(r["parts"], key=lambda p: p["number"])
            head = parts[0]
            if head["number"] == 0:
                out.append({k: head[k] for k in _ROW.names if k != "origin"} | {"origin": r["origin"]})
                continue
            block, total = b"".join(p["data"] for p in parts), parts[-1]["total"]
            if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total != len(block):
                raise ValueError(f"{r['origin']}: segments {[p['number'] for p in parts]} of {len(block)} bytes, {total} expected")
            payload = http_payload(block)
            out.append({k: head[k] for k in _ROW.names if k != "origin"} | {
                "origin": r["origin"], "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "data": payload if with_payload else None})
        yield pa.RecordBatch.from_pylist(out, _ROW)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per response and revisit of the archives in ``path``: page_id, uri, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A revisit takes its length from the response that it refers to and whose digest it bears.  A broken archive (a missing
    segment, a wrong length, a digest that the payload doesn't have) fails the query.  An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    rows = files.mapInArrow(lambda b: _read(b, with_payload), _ROW_SQL)
    parts = F.collect_list(F.struct(*[c for c in _ROW.names if c != "origin"])).alias("parts")
    # a record without segments is a group of its own, even where archives repeat an id
    own = F.when(F.col("number") == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    whole = rows.withColumn("own", own).groupBy("origin", "own").agg(parts).select("origin", "parts").mapInArrow(lambda b: _assemble(b, with_payload), _ROW_SQL)
    page = lambda c: F.regexp_extract(c, r"^<urn:lorekeep:page:(\d+|-\d+|None)", 1).try_cast("long")
    whole = whole.select(
        page(F.col("origin")).alias("page_id"), "uri", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"),
        "digest", F.col("data").alias("payload"))
    whole = materialize(whole, "records")
    bad = F.raise_error(F.concat(F.lit("wrong payload digest of page "), F.col("page_id").cast("string")))
    checked = whole.where("record_type = 'response'").withColumn(
        "payload_digest", F.when(F.col("digest").isNull() | (F.col("digest") == F.col("payload_digest")), F.col("payload_digest")).otherwise(bad))
    known = checked.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.first("payload_bytes").alias("known_bytes"))
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("page_id").cast("string")))
    revisits = whole.where("record_type = 'revisit'").drop("payload_bytes").join(known, ["refers_to", "digest"], "left")
    revisits = revisits.withColumns({"payload_bytes": F.coalesce("known_bytes", lost.cast("bigint")), "payload_digest": F.col("digest")})
    columns = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    return checked.select(*columns).unionByName(revisits.select(*columns))


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives (in the shared scratch folder unless ``path`` is given) and read them back."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
