"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing: payloads of at least ``min_dedup`` bytes are grouped by SHA-1 (grouped maximum,
combined before its shuffle); the row with the largest page_id is the response and the others
revisit it without a payload.  Each record is one string, written by Spark's text writer with
the record's last newline as its separator, into the shared folder: any executor can read it.
Records are written by classes of size, each with its own number of records a file, so that a
file has at most ``FILE_BYTES`` of blocks, or one record.

Reading: a file is searched chunk by chunk for the magic.  Each find is only a candidate, since
a payload may hold the magic too: from its header comes the offset of its successor.  Pointer
jumping (squaring the successor map) from offset 0 marks what is reachable, in a number of
vectorised steps that is the logarithm of the number of records; all else is dropped.

Defined cases: null html is an empty payload; a null page_id is written as ``null`` and read as
null, and is the smallest; rows that repeat the largest page_id of their payload are all
responses; no pages give no records.  A file whose chain does not end at its end raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder

MAGIC = b"WARC/1.1\r\n"
MIN_DEDUP = 1000
#: Records a file, and bytes of blocks; they bound what a reading task holds.
RECORDS_PER_FILE, FILE_BYTES = 4096, 64 << 20
#: The rows (16 bytes each) up to which the table of revisited payloads is broadcast; above, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
CHUNK = 4 << 20

RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def plan_records(pages: DataFrame, min_dedup: int = MIN_DEDUP) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    large = rows.where(F.col("payload_bytes") >= min_dedup).select("page_id", "payload_digest")
    shared = large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1").select("payload_digest", "response")
    small = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(shared) if small else shared, "payload_digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to")
    )


def block_of(records: DataFrame) -> F.Column:
    """What a record holds: a revisit nothing, a response its payload."""
    return F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))


def as_text(records: DataFrame) -> DataFrame:
    """One string a record, without its last newline."""
    eol = F.lit("\r\n")
    revisit = F.col("record_type") == "revisit"
    block = block_of(records)
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat(
        F.lit(MAGIC.decode()), F.lit("WARC-Type: "), F.col("record_type"), eol, F.lit("WARC-Record-ID: "), name, eol, F.lit("WARC-Target-URI: "), url, eol,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), eol, F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"), eol,
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"))).otherwise(""),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), eol, eol,
    )
    return records.select(F.concat(header, block, F.lit("\r\n\r")).alias("value"))


def size_class(size: F.Column, file_bytes: int) -> F.Column:
    """0 for blocks of which RECORDS_PER_FILE fit a file, and one more for each sixteenth of that number; the last class has one record a file."""
    n, k, out = RECORDS_PER_FILE, 0, None
    while n > 1:
        fits = size <= file_bytes // n
        out = F.when(fits, k) if out is None else out.when(fits, k)
        n, k = n // 16, k + 1
    return out.otherwise(k)


def write(pages: DataFrame, path: str, min_dedup: int = MIN_DEDUP, file_bytes: int = FILE_BYTES) -> None:
    """Archives of pages under path, a folder for each class of sizes that there is (and for the smallest); one pass over pages for each."""
    sizes = pages.select(size_class(F.octet_length(F.coalesce(F.col("html"), F.lit(""))), file_bytes).alias("k")).distinct().collect()  # at most four rows
    records = plan_records(pages, min_dedup)
    for k in sorted({0, *(r.k for r in sizes)}):
        own = records.where(size_class(F.octet_length(block_of(records)), file_bytes) == k) if len(sizes) > 1 or k else records
        as_text(own).write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, RECORDS_PER_FILE >> 4 * k)).text(f"{path}/size={k}")


def candidates(data: memoryview | bytes, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Offsets where the magic stands, and the offset after the record that would begin there (-1: no whole header)."""
    data = bytes(data)
    at, after = [], []
    for lo in range(0, max(len(data), 1), chunk):
        i = data.find(MAGIC, lo, lo + chunk + len(MAGIC) - 1)
        while i >= 0:
            end = data.find(b"\r\n\r\n", i)
            length = data.find(b"\r\nContent-Length: ", i, end) if end > 0 else -1
            value = data[length + 18 : data.find(b"\r\n", length + 18)] if length > 0 else b""
            at.append(i)
            after.append(end + 4 + int(value) + 4 if value.isdigit() else -1)
            i = data.find(MAGIC, i + 1, lo + chunk + len(MAGIC) - 1)
    return np.array(at, np.int64), np.array(after, np.int64)


def reachable(at: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain from offset 0 passes, by pointer jumping."""
    n = len(at)
    to = np.searchsorted(at, after)
    ok = (after >= 0) & (to < n) & (at[np.minimum(to, max(n - 1, 0))] == after) if n else np.zeros(0, bool)
    jump = np.append(np.where(ok, to, n), n)  # n: no successor
    reached = np.zeros(n + 1, bool)
    if n and at[0] == 0:
        reached[0] = True
    for _ in range(n.bit_length()):  # after k steps: the first 2**k of the chain
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    found = reached[:n]
    last = after[np.flatnonzero(found)[-1]] if found.any() else 0
    if last != size:
        raise ValueError(f"the chain of records ends at {last} of {size} bytes")
    return found


def _field(header: bytes, name: bytes) -> bytes | None:
    i = header.find(b"\r\n" + name + b": ")
    return None if i < 0 else header[i + len(name) + 4 : header.find(b"\r\n", i + 2)]


def _page(value: bytes | None) -> int | None:
    number = value[len(b"<urn:page:") : -1] if value else b""
    return int(number) if number.lstrip(b"-").isdigit() else None


def parse_file(data: bytes, payloads: bool) -> list[tuple]:
    at, after = candidates(data)
    found = reachable(at, after, len(data))
    rows = []
    for i, end in zip(at[found].tolist(), after[found].tolist(), strict=True):
        head = data.find(b"\r\n\r\n", i) + 4
        header, block = data[i:head], data[head : end - 4]
        kind = _field(header, b"WARC-Type").decode()
        length, digest = int(_field(header, b"X-Payload-Length")), _field(header, b"WARC-Payload-Digest")[5:].decode()
        if kind == "response" and (length != len(block) or digest != hashlib.sha1(block).hexdigest()):
            raise ValueError(f"the record at {i} does not hold the payload that its header names")
        rows.append((_page(_field(header, b"WARC-Record-ID")), _field(header, b"WARC-Target-URI").decode(), kind, length, digest, _page(_field(header, b"WARC-Refers-To")), block if payloads else None))
    return rows


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path; a revisit's payload is empty (the block), its length and digest are the full payload's."""

    def parse(batches):
        import pyarrow as pa

        arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for data in batch.column(0):
                rows = parse_file(data.as_py(), payloads)
                for k in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1024], strict=True), arrow.types, strict=True)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = shared_folder(spark)
    write(pages, path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM m
"""
