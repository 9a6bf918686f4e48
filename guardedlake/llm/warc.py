"""WARC archives: writing, reading, and revisit resolution.

Archives are gzip files that Spark's own text writer and reader move, so they can lie in
any store that Spark reaches; a record ends with the blank lines that the format asks
for, which are the writer's line separator. Files end after a number of records that
keeps each, and with it what a reading task holds, near a chosen size.

For resolution the smallest page id of each payload is found from headers alone: digest,
length and page, reduced before the shuffle. Its record becomes the response, the others
revisit records with fresh headers that name it. The join that tells each page its
response moves whole records, payloads included, once by digest; Spark splits it where
one payload is very common. When
archives are read back, revisit records are joined to their responses by page, which
gives their payloads' length.

Defined results: a null payload is empty; payloads are compared by SHA-1 and length;
payloads shorter than a limit are never revisits; of rows that repeat page and payload
all come out, those with the smallest id as responses. A null page id comes after all
others; if a payload has no other, its records are responses. Line ends in a url become
blanks in the header. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardedlake.llm.texts import let

# The version line, the end of a record, and the digest's alphabet.
VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"

READ = "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of bytes in bare base32: five hexadecimal digits are four letters."""
    def letters(number: Column) -> Column:
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(number, 5 * (3 - k)).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)])

    def encoded(digest: Column) -> Column:
        numbers = F.array(*[F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)])
        return F.array_join(F.transform(numbers, letters), "")

    # Once for a row: as a plain expression, the digest would be computed anew for each letter that names it.
    return let(F.sha1(payload), encoded)


def payloads(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload (bytes), length, digest."""
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    return rows.withColumns({"length": F.octet_length("payload").cast("bigint"), "digest": base32_sha1(F.col("payload"))})


def resolve(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` (page_id, digest, length and more) with ``refers_to``: the page that a revisit repeats, null for a response."""
    headers = records.where(F.col("length") >= min_bytes).groupBy("digest", "length").agg(F.min("page_id").alias("_first"))
    repeats = (F.col("_first").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return records.join(headers, ["digest", "length"], "left").withColumn("refers_to", F.when(repeats, F.col("_first"))).drop("_first")


def _record(row_of: dict[str, Column]) -> Column:
    """A record without its end: fresh headers, a blank line, the payload."""
    revisit = row_of["refers_to"].isNotNull()
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(row_of["payload"])
    number = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number(row_of["page_id"]), F.lit(">")), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(row_of["url"], "[\\r\\n]+", " ")), F.lit("Content-Type: text/html"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), row_of["digest"]),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), number(row_of["refers_to"]), F.lit(f">\r\nWARC-Profile: {PROFILE}"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines).cast("binary"), F.lit("\r\n\r\n").cast("binary"), block).cast("string")


def write_archives(resolved: DataFrame, path: str, records_per_file: int) -> None:
    """Deduplicated archives in ``path``, written where the join with the headers has left the records."""
    columns = {c: F.col(c) for c in ("page_id", "url", "payload", "digest", "refers_to")}
    writer = resolved.select(_record(columns).alias("value")).write.option("compression", "gzip").option("lineSep", RECORD_END)
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def records_per_file(pages: DataFrame, html: str = "html") -> int:
    """How many records keep a file near the chosen size, by the pages' mean length."""
    row = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(html)).alias("size")).first()
    return max(1, row["n"] * FILE_BYTES // max(row["size"] or 0, row["n"] * 256, 1))


HEADER = re.compile(rb"([A-Za-z-]+): ?(.*)")


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of each record of an archive; blocks are cut by their length."""
    at = 0
    while data.startswith(VERSION.encode(), at):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(m.groups() for m in map(HEADER.fullmatch, data[at:end].split(b"\r\n")[1:]) if m)
        start, size = end + 4, int(headers[b"Content-Length"])
        yield headers, data[start:start + size]
        at = start + size + len(RECORD_END)
    if at < len(data):
        raise ValueError(f"no record at byte {at}")


def _page(value: bytes | None) -> int | None:
    found = re.search(rb"urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            raw = zlib.decompress(content.as_py(), 31) if content.as_py() else b""
            for h, block in parse(raw):
                rows.append((_page(h.get(b"WARC-Record-ID")), h[b"WARC-Target-URI"].decode("utf-8", "replace"), h[b"WARC-Type"].decode(), h[b"WARC-Payload-Digest"].split(b":")[-1].decode(), _page(h.get(b"WARC-Refers-To")), block))
                size += len(block)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "record_type", "payload_digest", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, READ)


def with_originals(records: DataFrame) -> DataFrame:
    """``records`` with ``payload_bytes`` of the full payload: a revisit's is that of the response it refers to."""
    own = records.select("page_id", "url", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("bigint").alias("_own"), base32_sha1(F.col("payload")).alias("_seen"))
    lengths = own.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.max("_own").alias("_length"))
    both = own.join(lengths, (own["refers_to"] == lengths["_page"]) & (own["payload_digest"] == lengths["_digest"]), "left")
    full = F.when(F.col("record_type") == "revisit", F.col("_length")).otherwise(F.col("_own"))
    digest = F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.col("_seen"))
    return both.select("page_id", full.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "url")
