"""Operator 5: WARC archives through a table of record chunks.

Writing: each page becomes chunk rows (record id, chunk number, at most CHUNK bytes of payload); an oversized
payload becomes a record with continuation segments, one per chunk, so that no step needs a whole record beside
the value it came from. Rows go through Spark's text writer, whose line end is the blank lines that close a WARC
record, into gzip files. Reading: each file is inflated piece by piece and parsed; the segments of a record meet
again in chunk order, and a digest carried from chunk to chunk is checked at the last one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanward.llm.common import column_or_null, slices

#: Payload bytes of a chunk, at most.
CHUNK = 1 << 16
#: Records per file: with CHUNK this bounds a file.
PER_FILE = 1024
#: Payloads shorter than this are never revisits.
LEAST = 100
_END = b"\r\n\r\n"
#: Fixed by the WARC 1.1 standard.
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK_SCHEMA = ("record string, chunk long, last boolean, kind string, page_id long, refers_to long, "
                 "total long, digest string, data binary")


def chunks_of(data: bytes, size: int = CHUNK) -> Iterator[memoryview]:
    """Views of at most ``size`` bytes that don't cut a UTF-8 character; one empty view for no data."""
    view, at = memoryview(data), 0
    while True:
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield view[at:end]
        at = end
        if at >= len(data):
            return


def _quoted(url: str) -> str:
    """A target URI that stays on its header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(page_id: int | None, copy: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{copy}>"


def record_rows(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
                copy: str, size: int = CHUNK) -> Iterator[str]:
    """The WARC records of a page, each without its closing blank lines."""
    digest = hashlib.sha256()
    for part in chunks_of(payload, size):
        digest.update(part)
    origin = _record(page_id, copy)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {origin}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest.hexdigest()}",
        f"WARC-Page-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {'' if refers_to is None else refers_to}",
                 "Content-Length: 0"]
        yield "\r\n".join(head) + "\r\n\r\n"
        return
    many, sent = len(payload) > size, 0
    for number, part in enumerate(chunks_of(payload, size), 1):
        sent += part.nbytes
        if number > 1:
            head = ["WARC/1.1", "WARC-Type: continuation", f"WARC-Record-ID: {origin[:-1]}:{number}>",
                    "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Segment-Origin-ID: {origin}"]
        segment = [f"WARC-Segment-Number: {number}"] if many else []
        if many and sent == len(payload):
            segment.append(f"WARC-Segment-Total-Length: {len(payload)}")
        yield "\r\n".join([*head, *segment, "Content-Type: text/html; charset=utf-8",
                           f"Content-Length: {part.nbytes}"]) + "\r\n\r\n" + str(part, "utf-8")


class Parser:
    """Records of a WARC stream that arrives in pieces; holds one chunk record at a time."""

    def __init__(self) -> None:
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.buffer += data
        start = 0
        while (end := self.buffer.find(_END, start)) >= 0:
            lines = self.buffer[start:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"no WARC record at this place: {lines[0][:80]!r}")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            stop = end + 4 + int(fields["Content-Length"])
            if stop + 4 > len(self.buffer):
                break
            if self.buffer[stop:stop + 4] != _END:
                raise ValueError("a record is longer or shorter than it says")
            yield fields, bytes(self.buffer[end + 4:stop])
            start = stop + 4
        del self.buffer[:start]

    def close(self) -> None:
        if self.buffer:
            raise ValueError("the archive ends within a record")


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), refers_to and revisit.

    Of equal payloads of at least LEAST bytes the smallest page_id is the response; rows that share it are all
    responses, as is a row with a null page_id that meets no other id.
    """
    rows = pages.select(F.col("page_id").cast("long"), column_or_null(pages, "url", "string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.when(F.octet_length("html") >= LEAST, F.unhex(F.sha2("html", 256))))
    first = (rows.where(F.col("sum").isNotNull()).groupBy(F.col("sum").alias("of"))
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = rows.join(first, F.col("sum") == F.col("of"), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return rows.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"),
                       revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, size: int = CHUNK, per_file: int = PER_FILE) -> None:
    """Write gzip WARC files of at most ``per_file`` records into ``folder``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        weight = 0
        copies = 0
        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                copies += 1
                for text in record_rows(row["page_id"], row["url"], row["html"].encode(), row["refers_to"],
                                        row["revisit"], f"{row['part']}-{copies}", size):
                    held.append(text)
                    weight += len(text)
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    rows = with_roles(pages).withColumn("part", F.spark_partition_id())
    rows.mapInArrow(run, "value string").write.option("lineSep", _END.decode()).option(
        "compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The archives' chunk rows: record, chunk, last, kind, page_id, refers_to, total, digest, data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                parser, inflate = Parser(), zlib.decompressobj(31)
                raw, rows, weight = content.as_buffer(), [], 0
                for at in range(0, len(raw), 1 << 18):
                    for fields, data in parser.feed(inflate.decompress(raw[at:at + (1 << 18)])):
                        rows.append(_chunk_row(fields, data))
                        weight += len(data)
                    if weight > 4 << 20:
                        yield _chunk_batch(rows)
                        rows, weight = [], 0
                for fields, data in parser.feed(inflate.flush()):
                    rows.append(_chunk_row(fields, data))
                parser.close()
                yield _chunk_batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(run, _CHUNK_SCHEMA)


def _chunk_row(fields: dict[str, str], data: bytes) -> tuple:
    number = int(fields.get("WARC-Segment-Number", 1))
    whole = "WARC-Segment-Number" not in fields
    page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To")
    total = fields.get("WARC-Page-Payload-Length")
    return (fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), number,
            whole or "WARC-Segment-Total-Length" in fields, fields["WARC-Type"], int(page) if page else None,
            int(refers) if refers else None, int(total) if total else None,
            fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, data)


_ARROW = pa.schema([
    ("record", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("kind", pa.string()),
    ("page_id", pa.int64()), ("refers_to", pa.int64()), ("total", pa.int64()), ("digest", pa.string()),
    ("data", pa.binary())])


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)],
                                      schema=_ARROW)


class Digests:
    """Carries the digest of the record whose chunks are passing, and checks it when the last one has passed."""

    def __init__(self) -> None:
        self.record: str | None = None

    def take(self, row: dict) -> dict | None:
        """The finished record, at its last chunk."""
        if row["record"] != self.record:
            self.close()
            if row["chunk"] != 1:
                raise ValueError(f"{row['record']} lacks its first chunk")
            self.record, self.first, self.sum, self.size, self.next = row["record"], row, hashlib.sha256(), 0, 1
        if row["chunk"] != self.next:
            raise ValueError(f"{self.record} lacks chunk {self.next}")
        self.next += 1
        self.sum.update(row["data"])
        self.size += len(row["data"])
        if not row["last"]:
            return None
        first, self.record = self.first, None
        if first["kind"] != "revisit" and (self.sum.hexdigest(), self.size) != (first["digest"], first["total"]):
            raise ValueError(f"{first['record']} is damaged")
        return {"page_id": first["page_id"], "payload_bytes": first["total"], "payload_digest": first["digest"],
                "record_type": first["kind"], "refers_to": first["refers_to"]}

    def close(self) -> None:
        if self.record is not None:
            raise ValueError(f"{self.record} lacks its last chunk")


def read_records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, its digest checked.

    Records of one chunk are finished where they are read; only the segments of longer ones are shuffled, by
    record, and sorted by chunk number.
    """
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        for batch in batches:
            done = [r for row in batch.to_pylist() if (r := digests.take(row))]
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        digests.close()

    single = (F.col("chunk") == 1) & F.col("last")
    long = chunks.where(~single).repartition("record").sortWithinPartitions("record", "chunk")
    return chunks.where(single).mapInArrow(run, out).unionByName(long.mapInArrow(run, out))
