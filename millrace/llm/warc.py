"""WARC archives written and read by Spark, and transactions assembled from their records.

A page becomes three records: a response (or a revisit of an earlier equal
payload), the request that asked for it and a metadata record.  The two latter
name the first in ``WARC-Concurrent-To``; joining them gives one nested row per
capture again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.exchange import arrow_schema, stored
from millrace.session import scratch_path

#: Payloads below this size are always stored.
REVISIT_BYTES = 1000
#: Pages in one archive file; it bounds what a reader holds.
PAGES_PER_FILE = 4000

_END = "\r\n\r\n"

_RECORD = (
    "record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, "
    "content_type string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    groups = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    lines: list[Column] = [F.lit("WARC/1.1")]
    for name, value in headers:
        text = value if isinstance(value, Column) else F.lit(value)
        lines.append(F.concat(F.lit(f"{name}: "), text))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    # concat_ws leaves out headers whose value is null
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Writes a transaction of three records for each row of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8, empty for null.  Among equal payloads of
    at least ``least`` bytes the largest page_id is a response, the others are
    revisits of it; rows that tie for it are all responses.  A null url writes
    no target, a null page_id no page number.  Files are gzip; the end of a
    record is the separator Spark's text writer puts after each row.  Other columns are not read;
    an empty table writes no record.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace("url", "[\\x00-\\x1F\\x7F]", "").alias("url"),
        html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
    )
    # A hot payload is reduced to one row in each task; only repeated ones are looked up.
    largest = stored(
        rows.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies"),
        "warc-repeats",
    )
    first = F.col("first_id")
    known = (
        rows.join(largest, "digest", "left")
        .withColumn("revisit", (F.col("size") >= least) & first.isNotNull() & ~F.col("page_id").eqNullSafe(first))
        .withColumn("id", _uuid(F.lit("response"), F.col("page_id"), F.col("digest")))
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(_END),
    )
    request = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + _END))
    number = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    when = "2024-01-01T00:00:00Z"
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    refers = F.when(F.col("revisit"), _uuid(F.lit("response"), first, F.col("digest")))
    profile = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    answer = _record(
        [
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.col("id")),
            ("WARC-Date", when),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", profile),
            ("WARC-Refers-To", refers),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))),
    )

    def beside(kind: str, content: str, block: Column) -> Column:
        return _record(
            [
                ("WARC-Type", kind),
                ("WARC-Record-ID", _uuid(F.lit(kind), F.col("page_id"), F.col("digest"))),
                ("WARC-Date", when),
                ("WARC-Target-URI", F.col("url")),
                ("WARC-Concurrent-To", F.col("id")),
                ("Content-Type", content),
            ],
            block,
        )

    records = F.array(
        answer,
        beside("request", "application/http; msgtype=request", request),
        beside("metadata", "application/warc-fields", number),
    )
    (
        known.select(F.explode(records).alias("value"))
        .write.option("lineSep", _END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * PAGES_PER_FILE)
        .text(path)
    )


class _Stream:
    """Bytes of one archive, decompressed as they are asked for."""

    def __init__(self, content: memoryview):
        self.rest, self.held, self.at = content, b"", 0
        self.zip = zlib.decompressobj(31) if bytes(content[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if not self.rest:
            return False
        piece, self.rest = self.rest[: 1 << 18], self.rest[1 << 18 :]
        if self.zip is not None:
            made = self.zip.decompress(piece)
            while self.zip.eof and (left := self.zip.unused_data):  # the next gzip member
                self.zip = zlib.decompressobj(31)
                made += self.zip.decompress(left)
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
        else:
            made = bytes(piece)
        self.held = self.held[self.at :] + made
        self.at = 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        looked = self.at
        while (found := self.held.find(mark, looked)) < 0:
            kept = len(self.held) - self.at
            if not self._more():
                return None
            looked = max(0, kept - len(mark))
        out = self.held[self.at : found]
        self.at = found + len(mark)
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = self.held[self.at : self.at + size]
        self.at += size
        return out


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n"))
    return {name.strip().lower(): value.strip() for name, mark, value in pairs if mark}


def parse(content: memoryview, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive, plain or gzip; blocks are cut by Content-Length alone."""
    stream = _Stream(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        named = _fields(head)
        block = stream.take(int(named.get("content-length", 0)))
        stream.take(4)
        kind, content_type = named.get("warc-type"), named.get("content-type", "")
        fields: dict[str, str] = {}
        payload = block
        if content_type.startswith("application/http"):
            start, _, payload = block.partition(b"\r\n\r\n")
            fields = _fields(start)
        elif content_type == "application/warc-fields":
            fields, payload = _fields(block), b""
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        stated = named.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "revisit":  # its payload is that of the record it refers to
            size, digest = int(fields.get("content-length", 0)), stated
        elif stated and stated != digest:
            raise ValueError(f"payload of {named.get('warc-record-id')} does not match its digest")
        yield {
            "record_id": named.get("warc-record-id"),
            "warc_type": kind,
            "concurrent_to": named.get("warc-concurrent-to"),
            "refers_to": named.get("warc-refers-to"),
            "target_uri": named.get("warc-target-uri"),
            "content_type": content_type,
            "payload_bytes": size,
            "payload_digest": digest,
            "fields": list(fields.items()),
            "payload": payload if payloads and kind == "response" else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``."""

    schema = arrow_schema(_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held: list[dict] = []
                size = 0
                for record in parse(memoryview(content.as_buffer()), payloads):
                    held.append(record)
                    size += 500 + len(record["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata records.

    Records meet through ``WARC-Concurrent-To``, whichever side states it.
    Captures that share an identifier keep all their records; a response
    without others has empty lists, a request without a response gives no row.
    """
    capture = F.col("warc_type").isin("response", "revisit")
    key = F.coalesce("concurrent_to", "record_id")
    one = F.struct(*[F.col(c) for c in records.columns])

    def kind(name: str) -> Column:
        return F.collect_list(F.when(F.col("warc_type") == name, one))

    return (
        records.groupBy(key.alias("capture"))
        .agg(
            F.collect_list(F.when(capture, one)).alias("captures"),
            kind("request").alias("requests"),
            kind("metadata").alias("metadata"),
        )
        .select("capture", F.posexplode("captures").alias("place", "response"), "requests", "metadata")
        .select(
            F.col("response.record_id").alias("record_id"),
            F.col("response.warc_type").alias("warc_type"),
            F.col("response.refers_to").alias("refers_to"),
            "response",
            F.get("requests", F.col("place")).alias("request"),
            F.get("metadata", F.col("place")).alias("metadata"),
        )
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` written to the shared folder, read back and resolved.

    One row per page: page_id, payload_bytes, payload_digest, record_type and
    refers_to, the page_id of the response that a revisit stands for.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    captures = stored(
        transactions(read_archives(spark, path, payloads=False)).select(
            F.nullif(F.col("metadata.fields")["page-id"], F.lit("")).cast("long").alias("page_id"),
            "record_id",
            F.col("refers_to").alias("refers_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            F.col("warc_type").alias("record_type"),
        ),
        "captures",
    )
    wanted = captures.where("refers_id IS NOT NULL").select(F.col("refers_id").alias("wanted_id")).distinct()
    responses = captures.where("record_type = 'response'").select("record_id", F.col("page_id").alias("refers_to"))
    revisited = stored(
        wanted.join(responses, F.col("wanted_id") == F.col("record_id"))
        .groupBy(F.col("wanted_id").alias("refers_id"))
        .agg(F.max("refers_to").alias("refers_to")),
        "revisited",
    )
    return captures.join(revisited, "refers_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
