"""Operator 8 - WARC archives with revisit resolution.

Headers (page id, payload digest, length) are written once and shuffled by digest without payloads; of equal payloads one
record keeps the payload as a ``response`` and the others become ``revisit`` records that refer to it. The archives are written with fresh
headers by Spark's text writer, gzipped, whose record separator is WARC's blank lines, so a write survives lost executors
and reaches any file system Spark reaches. Reading parses the records by their Content-Length, checks every payload against
its digest and joins revisits to their responses by record id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, n_partitions

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The base-32 alphabet of payload digests (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Archive files hold about so many payload bytes; a file is read by one task, as one row. A task writes about so many, in several files: the shuffle has as many partitions as the session says, or as these bytes ask for.
FILE_BYTES, TASK_BYTES = 24 << 20, 1 << 30
#: Rows that repeat an id and a payload more often than this, and than one in ``SHARE`` of all rows, are dealt to several tasks; there are at most ``SHARE`` such groups, and their list is broadcast.
REPEATED, SHARE = 1024, 10_000
PARSED = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_record string, payload_bytes long, payload binary"


def base32(digits: Column) -> Column:
    """Upper-case base 32 of 40 hex digits: each 5 of them are 20 bits, and so 4 characters."""
    bits = [F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in bits for s in (15, 10, 5, 0)])


def _record_id(page_id: Column, digest: Column) -> Column:
    """A record id that depends on the page id and the payload only, so reruns and retries agree."""
    h = F.sha1(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes and payload_digest.

    The two explodes of one value are borders that the optimizer doesn't fold expressions over: without them the hash would
    be computed anew for each of the digest's 32 characters, and the characters for each use of the digest.
    """
    lean = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    hashed = lean.select("*", F.explode(F.array(F.sha1(F.col("html").cast("binary")))).alias("hex"))
    return hashed.select("page_id", "url", "html", F.octet_length("html").cast("long").alias("payload_bytes"), F.explode(F.array(base32(F.col("hex")))).alias("payload_digest"))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, original): the revisits among headers (page_id, payload_digest, payload_bytes).

    Of equal payloads of at least ``min_bytes`` bytes, the record with the largest page_id is the original.
    """
    groups = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null")
    return headers.where(F.col("payload_bytes") >= min_bytes).join(groups.drop("n"), "payload_digest").where("not (page_id <=> original)").select("page_id", "payload_digest", "original").distinct()


def _record(date: str) -> Column:
    """A WARC record without its closing blank lines."""
    nl, revisit = F.lit("\r\n"), F.col("original").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, nl)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("WARC-X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("original"), F.col("payload_digest"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        nl,
        block,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, repeated: int = REPEATED, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archive files under ``path``.

    A null html is an empty payload; null urls and ids leave their header out; a row without an id never is an original,
    and equal payloads without any id all stay responses. Rows repeated with the same id and payload get the same type;
    where there are more than ``repeated`` of them, they are dealt to several tasks and files. Files hold as many records as
    make ``file_bytes`` of payload on average.
    """
    scratch = Scratch(pages.sparkSession, "warc-headers")
    rows = _with_digest(pages)
    headers = scratch.table(rows.select("page_id", "payload_digest", "payload_bytes"), "headers")
    total, n = headers.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*")).first()
    files = max(1, -(-total // file_bytes))
    tasks = min(files, max(n_partitions(pages.sparkSession), -(-total // TASK_BYTES)))
    records = max(1, -(-n // files))
    most = max(repeated, n // SHARE)
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "payload_digest")
    hot = F.broadcast(headers.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    revisits = resolve(headers, min_bytes).select(key.alias("key"), "original").join(hot, "key", "left").select("key", "original", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = rows.withColumn("key", key).join(hot, "key", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("parts")
    joined = dealt.repartition(tasks, "key", "part").join(revisits.repartition(tasks, "key", "part"), ["key", "part"], "left")
    joined.select(_record(date).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
    scratch.drop(headers)


def parse(data: bytes) -> Iterator[tuple]:
    """Records of one archive; payloads are those of responses, checked against their digests."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head, *lines = data[at:stop].split(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        h = {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines)}
        block, end = stop + 4, stop + 4 + int(h[b"content-length"])
        kind, digest = h[b"warc-type"].decode(), h[b"warc-payload-digest"].decode().removeprefix("sha1:")
        payload = data[data.index(b"\r\n\r\n", block) + 4 : end]
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload differs from its digest at byte {at}")
        page = h.get(b"warc-x-page-id")
        refers, url = h.get(b"warc-refers-to"), h.get(b"warc-target-uri")
        yield h[b"warc-record-id"].decode(), kind, page and int(page), url and url.decode(), digest, refers and refers.decode(), len(payload) if kind == "response" else None, payload if kind == "response" else None
        at = end + 4


def _parser(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARSED.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                some: list[tuple] = []
                for record in parse(gzip.decompress(content.as_py())):
                    some.append(record if payloads else (*record[:-1], None))
                    if len(some) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; revisits have null payload and payload_bytes here."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parser(payloads), PARSED)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Adds refers_to (the response's page_id) to revisits and gives them its payload_bytes."""
    originals = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes"))
    return records.join(originals, "refers_to_record", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).drop("_bytes")


def digest(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per row of ``pages``, repeated ones included. A null html is a payload of no bytes; rows with a null id are
    revisits of an equal payload that has an id, else responses; an empty table gives an empty result; other columns play
    no part.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    at = scratch.path("archives")
    write_archives(pages, at)
    records = scratch.table(read_archives(spark, at, payloads=False).drop("payload", "url"), "records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """The same rows in DuckDB."""
    char = f"substr('{BASE32}', (('0x' || substr(sha1(coalesce(html, '')), 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) % 32 + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, array_to_string([{char} FOR i IN range(32)], '') AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS original FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to FROM p JOIN g ON p.payload_digest = g.payload_digest
"""
