"""WARC archives whose records are Zstandard frames under one dictionary, which leads the file in a skippable frame.

File layout: a skippable frame (magic 0x184D2A5D) with the dictionary, then one frame for each record, so that a
record is read by its offset alone.  Page records are HTTP responses; a payload that an earlier page (by id) has too is written
as a revisit without payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.storage import fresh, put

#: Skippable frame that holds a dictionary.
MAGIC = 0x184D2A5D
#: Expected records and most bytes of each that the dictionary is built from, and the dictionary's size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
#: The tables carry no crawl time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_value(text: str | None) -> str:
    """A value on one line: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "about:blank")


def record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])]


def skippable(data: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(data)) + data


def frames(data: memoryview, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame after the leading dictionary."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size]))) if size else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(data):
        one, out, upto = reader.decompressobj(), [], at
        while not one.eof:
            if upto >= len(data):
                raise ValueError("the archive ends inside a record")
            out.append(one.decompress(data[upto : upto + chunk]))
            upto = min(upto + chunk, len(data))
        yield at, b"".join(out)
        at = upto - len(one.unused_data)


def build_dictionary(pages: DataFrame, id_col: str, html_col: str) -> bytes:
    """From a hash sample of about SAMPLE_RECORDS records over all partitions, at most SAMPLE_BYTES of each: a bounded 16 MB or so."""
    n = pages.count()
    kept = F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(max(1, n // SAMPLE_RECORDS))) == 0
    rows = pages.where(kept).select(F.substring(F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary"), 1, SAMPLE_BYTES).alias("head")).limit(4 * SAMPLE_RECORDS).collect()
    samples = [record(0, "http://host/", bytes(r.head), None, False) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from; records then stand alone
        return b""


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row into archives in ``folder``; returns the index: file, records, bytes.

    Payloads are compared by SHA-1 and length; only payloads held by two rows or more are joined back to the rows.  Of equal
    payloads the smallest page id is the response (each row of it, if the id is repeated) and the others revisit it; a
    null id never is what others refer to, and a null id's row is a response.  Null html is an empty payload.  An empty table writes nothing.
    A file appears under its name only when whole, so a repeated task does no harm.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("key", F.concat(F.sha1("payload"), F.lit("-"), F.octet_length("payload")))
    twice = keyed.where(F.col("id").isNotNull()).groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    dictionary = build_dictionary(pages, id_col, html_col)

    def run(batches):
        from pyspark import TaskContext

        own = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        part, number, out, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            name = f"pages-{part:06d}-{number:06d}.warc.zst"
            total = put(f"{folder}/{name}", [skippable(dictionary), *out])
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(out)], "bytes": [total]})

        for batch in batches:
            for page_id, url, data, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = page_id is not None and first is not None and first != page_id
                out.append(own.compress(record(page_id, url, data, first, revisit)))
                size += len(out[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out, size, number = [], 0, number + 1
        if out:
            yield close()

    joined = keyed.join(twice, "key", "left").select("id", "url", "payload", "first")
    return joined.mapInArrow(run, "file string, records long, bytes long")


def read_archives(spark, folder: str) -> DataFrame:
    """Each page record of the archives: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, file, offset.

    The digest of a response is taken anew from its payload and compared with its header.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for offset, data in frames(memoryview(content.as_buffer())):
                    headers, block = parsed(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = headers["warc-payload-digest"].partition(":")[2], headers["warc-type"]
                    length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
                        raise ValueError(f"{path} at {offset}: payload and digest differ")
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    rows.append(
                        {"page_id": None if page is None else int(page), "url": headers["warc-target-uri"], "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest,
                         "record_type": kind, "refers_to": None if refers is None else int(refers), "file": path.rpartition("/")[2], "offset": offset}
                    )
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long")


def op10_dictionary_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "warc")
    index = fresh(spark, "warc-index")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder).write.parquet(index)
    if spark.read.parquet(index).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages
), q AS (
  SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
    + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
