"""WARC archives: writing pages as records, and reading archives back.

Writing. A payload is framed as a chunked HTTP response and becomes one record,
or, if its block is longer than ``segment_bytes``, a first record and
continuation records that name its id, count segments and, in the last one,
state the total length. Of pages with equal payloads of at least ``least_bytes``
the one with the smallest key is stored; the others become revisit records that
refer to it. Files are written by Spark's text writer (records end with two
line ends, as the format wants) into a folder of the caller's choice.

Reading. Files are parsed by the lengths that records state. Whole records
are decoded where they are; only those with continuations are gathered by the id
of their origin, put in order, checked for gaps and against the total length,
and then decoded.

Results for odd input: a null payload counts as empty; control characters in a
url are percent-encoded; an empty table gives no file and no row; repeated rows
of a key with equal payloads are all responses; a key that is null is written
as none, never stands for others, and reads back as null. A record whose
segments are incomplete, or whose length or digest is wrong, has ``intact`` false.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, removed, shared_folder

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
LEAST_BYTES = 100
#: A record holds a segment at most, so a file is of about 64 MB at most; readers hold one file at a time.
RECORDS_PER_FILE = 1000
#: Repeated payloads (about 100 bytes each) are broadcast up to this many.
FEW_GROUPS = 50_000
END = b"\r\n"
#: Fixed value: there is no capture time in the tables.
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def roles(pages: DataFrame, key: str, payload: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, url, body, n_bytes, digest, refers_to): refers_to is the smallest key with an equal payload, where that is another row's."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("n_bytes", F.octet_length("body").cast("long")).withColumn("digest", F.sha2("body", 256))
    groups = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    groups = checkpointed(groups)
    # few repeated payloads go to every task, so that no payload is shuffled; many are met by a shuffled join
    joined = rows.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("least") < F.col("id"), F.col("least"))).drop("least")


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes | None:
    """The content of a chunked body; None if the frame is broken."""
    out, at = [], 0
    while True:
        line = framed.find(END, at)
        if line < 0 or not (m := re.fullmatch(rb"([0-9A-Fa-f]+)[ \t]*(?:;.*)?", framed[at:line])):
            return None
        n = int(m[1], 16)
        if n == 0:
            return b"".join(out)
        at = line + 2 + n
        if framed[at : at + 2] != END:
            return None
        out.append(framed[line + 2 : at])
        at += 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records_of(key: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None, segment_bytes: int, place: str = "") -> Iterator[bytes]:
    """The records of one page, without the line ends after each; place tells rows of the same page apart."""
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}\n{url}\n{digest}\n{place}')}>"
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Page-ID", None if key is None else str(key)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(body)))]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", str(refers_to))], b"")
        return
    block = HTTP + chunked(body)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http;msgtype=response")], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", "1")], parts[0])
    for i, part in enumerate(parts[1:], 2):
        total = str(len(block)) if i == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}{i}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i)), ("WARC-Segment-Total-Length", total)], part)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", segment_bytes: int = SEGMENT_BYTES, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record for each row of pages into files below folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                n += 1
                for record in records_of(*row, segment_bytes, f"{task} {n}"):
                    out.append(record)
                    size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = roles(pages, key, payload, least_bytes).select("id", "url", "body", "digest", "refers_to").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).mode("overwrite").text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file: fields by lower-case name, and the block."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        length = int(fields.get("content-length", 0))
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


PAGES = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
PARTS = f"origin string, number int, total long, block binary, {PAGES}"
PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
PART_ARROW = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), *PAGE_ARROW])


def _long(x: str | None) -> int | None:
    return None if x is None else int(x)


def _decoded(fields: dict, block: bytes) -> dict:
    """A page from a record's fields and its whole block."""
    kind = fields.get("warc-type")
    digest, length = (fields.get("warc-payload-digest") or "").removeprefix("sha256:"), _long(fields.get("warc-payload-length"))
    page = {"page_id": _long(fields.get("warc-page-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _long(fields.get("warc-refers-to-page"))}
    if kind == "revisit":
        return page | {"payload_bytes": length, "payload_digest": digest, "intact": True}
    head, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        body = unchunked(body)
    if body is None:
        return page | {"intact": False}
    own = hashlib.sha256(body).hexdigest()
    return page | {"payload": body, "payload_bytes": len(body), "payload_digest": own, "intact": own == digest and len(body) == length}


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each page in the archives below folder; without payloads, only what is computed from them."""

    def reader(segments: bool):
        """Whole records decoded, or the segments as they are."""
        return lambda batches: run(batches, segments)

    def run(batches: Iterator[pa.RecordBatch], segments: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                data = data.as_py()
                if segments and b"WARC-Segment-Number" not in data:
                    continue
                for fields, block in parse(data):
                    number = _long(fields.get("warc-segment-number"))
                    if (number is None) == segments:
                        continue
                    if number is None:
                        row = _decoded(fields, block)
                        if not payloads:
                            row["payload"] = None
                    else:
                        row = {"origin": fields.get("warc-segment-origin-id") or fields["warc-record-id"], "number": number, "total": _long(fields.get("warc-segment-total-length")), "block": block}
                        if number == 1:
                            row |= {"page_id": _long(fields.get("warc-page-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_digest": fields.get("warc-payload-digest"), "payload_bytes": _long(fields.get("warc-payload-length"))}
                    out.append(row)
                    size += len(block)
                    if size > 4 << 20 or len(out) >= 5000:
                        yield pa.RecordBatch.from_pylist(out, PART_ARROW)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, PART_ARROW)

    def assemble(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["number"])
        first = parts[0]
        block = b"".join(r["block"] for r in parts)
        whole = [r["number"] for r in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
        fields = {"warc-type": first["record_type"], "warc-page-id": first["page_id"], "warc-target-uri": first["url"], "warc-payload-digest": first["payload_digest"], "warc-payload-length": first["payload_bytes"]}
        row = _decoded(fields, block) if whole else {"page_id": first["page_id"], "url": first["url"], "record_type": first["record_type"], "intact": False}
        if not payloads:
            row["payload"] = None
        return pa.Table.from_pylist([row], PAGE_ARROW)

    # nothing was written for an empty table
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    columns = [x.split()[0] for x in PAGES.split(", ")]
    whole = files.mapInArrow(reader(False), PARTS).select(*columns)
    return whole.unionByName(files.mapInArrow(reader(True), PARTS).groupBy("origin").applyInArrow(assemble, PAGES))


def round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write pages as archives and read them back."""
    spark = pages.sparkSession
    own = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder or own)
    found = read_archives(spark, folder or own, payloads)
    if folder is None and not payloads:  # what was computed is small; the archives can go
        found = checkpointed(found)
        removed(spark, own)
    return found


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND least < page_id THEN least END AS refers_to
FROM r"""
