"""WARC archives: writing with revisits and segments, reading, reassembly of segments."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, scratch_path, written

#: What archives are written with; those of any version that begins with MARK are read.
VERSION, MARK = b"WARC/1.1\r\n", b"WARC/1."
END = "\r\n\r\n"
MIN_REVISIT = 1000
SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 13
DATE = "2024-01-01T00:00:00Z"

RECORD = "record_id string, type string, page_id long, target_uri string, payload_digest string, refers_to_id string, origin_id string, segment_number int, total_length long, block binary, error string"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same for rows that are the same in all three."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _digest_field(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. No chunk holds what begins a record, so readers may split there."""
    out, at = [], 0
    while at < len(payload):
        to = min(at + size, len(payload))
        found = payload.find(MARK, at, to + len(MARK) - 1)
        if found >= 0:
            to = min(to, found + 4)
        out.append(b"%x\r\n%s\r\n" % (to - at, payload[at:to]))
        at = to
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[line + 2 : at])
        at += 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    clean = [(k, "".join("%%%02X" % ord(c) if c < " " else c for c in str(v))) for k, v in fields if v is not None]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in clean).encode() + b"\r\n"


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> list[bytes]:
    """The records of a page: a revisit, a response, or a response and its continuations."""
    own = record_id(page_id, url, digest)
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", _digest_field(digest)), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_head([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", refers_to), ("WARC-Profile", profile), ("Content-Length", len(head))]) + head]
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        return [_head([("WARC-Type", "response"), *common, ("Content-Length", len(block))]) + block]
    out, starts = [], range(0, len(block), segment_bytes)
    for k, start in enumerate(starts, 1):
        part = block[start : start + segment_bytes]
        numbers = [("WARC-Segment-Number", k), ("Content-Length", len(part))]
        if k == 1:
            fields = [("WARC-Type", "response"), *common, *numbers]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own} {k}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), *numbers]
            if k == len(starts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_head(fields) + part)
    return out


def write_warc(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) to WARC files under ``path``.

    The payload is the html in UTF-8, sent in chunks. Of rows with equal payloads of ``min_revisit`` bytes
    or more, that with the largest page_id is the response (all, if several rows have it), the others
    revisit it. Blocks over ``segment_bytes`` go on in continuation records. Files are made by Spark's text writer,
    record by record, so they may lie in any store, and no task holds a file.

    Null html is empty; a null page_id is the smallest, and rows without url have no target. An empty
    table gives an empty archive. Other columns are not read.
    """
    bound_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    long = pages.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("first"))
    long = written(long.filter((F.col("n") > 1) & F.col("first.page_id").isNotNull()).select("digest", F.col("first.page_id").alias("to_id"), F.col("first.url").alias("to_url")), "originals")
    rows = pages.join(long, "digest", "left").select("page_id", "url", "payload", "digest", "to_id", "to_url")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for page_id, url, payload, digest, to_id, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = record_id(to_id, to_url, digest) if to_id is not None and page_id != to_id else None
                out += records_of(page_id, url, payload, digest, refers, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows.mapInArrow(lay, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).text(path)


def parse_record(data: bytes) -> tuple:
    """Fields of RECORD from a record, its first line with or without MARK; error tells what is wrong with it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
    number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    length, error = number("content-length"), None
    if length is None or len(rest) < length:
        error = "its block is shorter than its Content-Length"
    elif rest[length:].strip(b"\r\n"):
        error = "its block is longer than its Content-Length"
    digest = fields.get("warc-payload-digest", "")
    if digest.startswith("sha1:"):
        digest = base64.b32decode(digest[5:]).hex() if len(digest) == 37 else digest[5:].lower()
    return (
        fields.get("warc-record-id"), fields.get("warc-type"), number("warc-page-id"), fields.get("warc-target-uri"), digest or None, fields.get("warc-refers-to"),
        fields.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), rest[:length], error,
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under ``path`` (plain or .gz), segments still apart.

    Files are read as streams that are split where a line begins with a version (1.0, 1.1), by Spark's own reader; a longer mark, with the
    empty line before it, may begin within itself, which that reader misses where its buffers end. A payload that itself holds that outside of chunked framing would be split too; its record then has an error, as
    has any whose block is not as long as it says.
    """
    bound_batches(spark)
    raw = spark.read.option("lineSep", "\n" + MARK.decode()).text(path).select(F.col("value").cast("binary").alias("value"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_record(x) for x in batch.column(0).to_pylist() if x]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, RECORD.split(", "), strict=True)])
    return raw.mapInArrow(parse, RECORD)


def joined_segments(segments: list[dict]) -> list[tuple[bytes | None, str | None]]:
    """Blocks of one origin: its segments by number, once for each time the first one is there."""
    first = [s for s in segments if s["segment_number"] == 1]
    by = {s["segment_number"]: s for s in segments}
    total = next((s["total_length"] for s in segments if s["total_length"] is not None), None)
    error = next((s["error"] for s in segments if s["error"]), None)
    block = b"".join(by[k]["block"] for k in sorted(by))
    if not error and sorted(by) != list(range(1, len(by) + 1)):
        error = "a segment is missing"
    if not error and (total is None or total != len(block)):
        error = "its segments do not add up to its total length"
    return [(None if error else block, error)] * max(1, len(first))


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: continuations join the response of their origin identifier, in order of segment number.

    Only segmented records are shuffled, each by its own identifier, so a group is as large as one record. The total
    length must be that of the joined segments, else the record has an error and no block. Records that
    were written twice come out twice. An empty archive gives no records; records without segment number pass as they are.
    """
    whole = records.filter(F.col("segment_number").isNull())
    parts = records.filter(F.col("segment_number").isNotNull()).withColumn("_origin", F.coalesce("origin_id", "record_id"))
    held = parts.groupBy("_origin").agg(F.collect_list(F.struct(*records.columns)).alias("segments"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for segments in batch.column(0).to_pylist():
                head = next((s for s in segments if s["segment_number"] == 1), segments[0])
                out += [head | {"block": block, "error": error, "segment_number": None, "total_length": None} for block, error in joined_segments(segments)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([pa.field(f.name, f.type) for f in batch.column(0).type.value_type]))

    return whole.unionByName(held.select("segments").mapInArrow(join, records.schema))


def payloads(records: DataFrame) -> DataFrame:
    """Adds payload, payload_bytes and sha1 of each response's HTTP message, its transfer framing decoded.

    A payload that does not have the record's digest is an error. Revisits have no payload, nor have records with an error. An empty
    archive gives no rows, repeated records are decoded each.
    """
    names = records.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row |= {"payload": None, "payload_bytes": None, "sha1": None}
                if row["type"] != "response" or row["error"]:
                    continue
                head, _, body = row["block"].partition(b"\r\n\r\n")
                try:
                    framed = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
                    row["payload"] = unchunked(body) if framed else body
                except ValueError as e:
                    row["error"] = str(e)
                    continue
                row |= {"payload_bytes": len(row["payload"]), "sha1": hashlib.sha1(row["payload"]).hexdigest()}
                if row["payload_digest"] and row["payload_digest"] != row["sha1"]:
                    row["error"] = "its payload does not have its digest"
            kinds = [*zip(names, (batch.schema.field(n).type for n in names), strict=True), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("sha1", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return records.mapInArrow(decode, ", ".join([RECORD, "payload binary, payload_bytes long, sha1 string"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``, whole and decoded; see ``read_records``, ``reassemble`` and ``payloads``."""
    return payloads(reassemble(read_records(spark, path)))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as ``write_warc`` does and reads the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, error.

    A revisit's bytes are those of the response it refers to, its digest is its own field.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    read = written(read_warc(spark, path).select("record_id", "type", "page_id", "payload_digest", "refers_to_id", "payload_bytes", "sha1", "error"), "records")
    responses = read.filter(F.col("type") == "response")
    named = written(responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("bytes")), "responses")
    revisits = read.filter(F.col("type") == "revisit").drop("payload_bytes").join(named, "refers_to_id", "left")
    own = responses.select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "error")
    return own.union(revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to", "error"))
