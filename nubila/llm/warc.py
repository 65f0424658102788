"""WARC archives with revisit records: written by Spark's text writer, read back from their bytes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, tune

#: Payloads below this many bytes are never revisits.
LEAST = 100
#: About how many bytes of payloads an archive file holds: a file takes as many records as have so many on average.
ARCHIVE_BYTES = 16 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = "[\\x00-\\x20\\x7F]"


def with_digests(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    html = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), _CONTROL, "%20")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("digest"))


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, origin, origin_url) of the payloads of at least that many bytes that occur more than once.

    Headers only are shuffled here, and copies of one payload meet in each map task first.
    """
    first = pages.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("o"), F.count("*").alias("c"))
    return first.where("c > 1").select("digest", F.col("o.page_id").alias("origin"), F.col("o.url").alias("origin_url"))


def record(date: str) -> F.Column:
    """A WARC/1.1 record without its closing line ends, from page_id, url, html, bytes, digest, origin, origin_url."""
    revisit = F.col("origin").isNotNull() & (F.col("origin") != F.col("page_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    none = F.lit("")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url") == "", none).otherwise(line("WARC-Target-URI", F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("origin")), F.when(F.col("origin_url") == "", none).otherwise(line("WARC-Refers-To-Target-URI", F.col("origin_url"))), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, none).otherwise(F.col("html")),
    )


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of pages below path, gzip-compressed WARC/1.1.

    Of equal payloads of at least ``least`` bytes, the row with the smallest id becomes the response; the others become
    revisit records with fresh headers that refer to it.  Null html is an empty payload; a null url leaves its header
    out; control characters of a url are escaped.  Rows without an id are responses.  A repeated id is written each time.

    Payloads go through one shuffle by digest, unless the decisions are small enough to be broadcast.
    """
    spark = pages.sparkSession
    rows = with_digests(pages, id_col, url_col, text_col)
    resolved = rows.join(resolve(rows, least), "digest", "left")
    mean = rows.agg(F.avg("bytes")).first()[0] or 0
    each = max(1, int(ARCHIVE_BYTES // (mean + 1)))
    resolved.select(record(date).alias("value")).write.option("maxRecordsPerFile", each).option("lineSep", END).option("compression", "gzip").text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def unpacked(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members, or of a plain file."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    rest = memoryview(raw)
    while len(rest):
        member = zlib.decompressobj(wbits=31)
        while len(rest) and not member.eof:
            yield member.decompress(rest[:size])
            rest = rest[size:]
        if not member.eof:
            raise ValueError("a gzip file ends early")
        if member.unused_data:
            rest = memoryview(member.unused_data + bytes(rest))


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers with lower-case names, block) of each record; of the pieces no more than a record's are held."""
    raw, at, pieces = bytearray(), 0, iter(pieces)

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        if at:
            del raw[:at]
            at = 0
        raw.extend(piece)
        return True

    while True:
        head = _HEAD.match(raw, at)
        if head is None:
            if more():
                continue
            if at == len(raw):
                return
            raise ValueError("no WARC record where one should begin")
        fields = dict(x.split(b": ", 1) for x in bytes(head[1]).split(b"\r\n"))
        fields = {k.lower(): v for k, v in fields.items()}
        begin, size = head.end() - at, int(fields[b"content-length"])
        del head  # it would keep raw from growing
        while len(raw) < at + begin + size + 4 and more():
            pass
        end = at + begin + size
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get(b'warc-record-id')} doesn't end where its length says")
        yield fields, bytes(raw[at + begin : end])
        at = end + 4


def _read(with_payload: bool):
    def number(urn: bytes | None) -> int | None:
        value = urn and urn[len(b"<urn:page:") : -1]
        return int(value) if value and value != b"none" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                raw = batch.column(0)[i].as_py()
                rows: list[tuple] = []
                for fields, block in parse(unpacked(raw)):
                    kind = fields[b"warc-type"].decode()
                    said = fields[b"warc-payload-digest"].removeprefix(b"sha256:").decode()
                    if kind == "response" and hashlib.sha256(block).hexdigest() != said:
                        raise ValueError(f"payload of {fields[b'warc-record-id']} doesn't match its digest")
                    rows.append((number(fields[b"warc-record-id"]), fields.get(b"warc-target-uri", b"").decode(), kind, said, len(block), number(fields.get(b"warc-refers-to")), block if with_payload else None))
                cols = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["page_id", "url", "record_type", "payload_digest", "block_bytes", "refers_to", "payload"])

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_digest, block_bytes, refers_to, payload) of the records below path.

    Each response's payload is checked against its digest.
    """
    tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read(with_payload), "page_id long, url string, record_type string, payload_digest string, block_bytes long, refers_to long, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the size of the payload of the response that it refers to."""
    origin = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("block_bytes").alias("origin_bytes"))
    joined = records.join(origin, ["refers_to", "payload_digest"], "left")
    return joined.withColumn("payload_bytes", F.when(F.col("record_type") == "revisit", F.col("origin_bytes")).otherwise(F.col("block_bytes")))


def revisit_table(pages: DataFrame, **columns) -> DataFrame:
    """Write the archives into the shared folder, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    ws = Workspace(pages.sparkSession, "warc")
    path = f"{ws.path}/archives"
    write_archives(pages, path, **columns)
    return resolve_revisits(read_archives(ws.spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
