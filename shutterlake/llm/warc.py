"""Content-addressed WARC store.

An archive is three tables under one root: `blobs` holds each payload's bytes once, keyed by their SHA-256, `responses`
the exact header bytes of each record that has a payload, with its key, and `revisits` those of the others. The original
records come back through a join of blobs and responses, both in buckets of the key, and each payload is verified
against both digests when it is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import forget, hot_limit, partitions_of, read, read_buckets, remove, shared_dir, spread_join, stored, write_buckets

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
RECORD_ID = "urn:x-page:"

#: Payload digests that one task remembers, so that it sends each payload once; with more it forgets and may send some again.
REMEMBERED = 1 << 18

#: Bytes of payloads, before they are compressed and copies merged, that fall into one bucket; its blobs are met in memory.
BUCKET_BYTES = 64 << 20

_BLOB = "sha256 binary, blob binary"
_RESPONSE = "page_id long, sha256 binary, header binary"


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload of a task once, compressed, with its digest."""
    pack = zstandard.ZstdCompressor(level=3).compress
    seen: set[bytes] = set()
    for batch in batches:
        keys, blobs = [], []
        for h in batch.column("html"):
            payload = h.as_buffer().to_pybytes() if h.is_valid else b""
            if (key := hashlib.sha256(payload).digest()) in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(key)
            keys.append(key)
            blobs.append(pack(payload))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["sha256", "blob"])


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest; all rows of a digest are in one task, at most a few for each task that sent it."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for key in batch.column("sha256").to_pylist():
            fresh.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def write_archive(pages: DataFrame, root: str, warc_date: str = "2024-01-01T00:00:00Z", revisit_min_bytes: int = 0) -> None:
    """Write one record per row of pages(page_id, url, html) into the archive at `root`.

    Of the records with equal payloads of at least `revisit_min_bytes`, that with the largest page_id is a response
    and the others revisit it; smaller payloads are always responses. Null html is the empty payload, a null url gives
    no target. A null page_id counts as smaller than any other. Rows that repeat the largest page_id and its payload
    are responses too, over one stored blob. A page of any length is one payload, held in memory by one task. An empty
    table gives an archive without records; extra columns are ignored.

    Payloads move once, each at most once per task that has it, to the bucket of their digest; headers move apart.
    """
    spark = pages.sparkSession
    # Digests alone decide the record types: no payload takes part in these shuffles.
    digests = stored(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
        .select("page_id", "url", F.unhex(F.sha2("payload", 256)).alias("sha256"), F.sha1("payload").alias("sha1_hex"), F.octet_length("payload").cast("long").alias("payload_bytes")),
        "warc-digests",
    )
    newest = digests.groupBy("sha256").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    # A hot payload's copies don't meet in one task.
    typed = spread_join(digests, newest, "sha256", F.col("n") > hot_limit(digests.count()), ["page_id"])
    revisit = (F.col("payload_bytes") >= revisit_min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    typed = typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("http", http)
    header = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"\r\nWARC-Date: {warc_date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", "")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), _base32("sha1_hex"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name("response_id"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.length("http") + F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))).cast("string"),
        F.lit("\r\n\r\n"), F.col("http"),
    )
    records = typed.select("page_id", "record_type", "sha256", F.encode(header, "UTF-8").alias("header"))
    records.where("record_type = 'revisit'").select("page_id", "header").write.parquet(f"{root}/revisits")
    total = digests.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("n")).first().n
    buckets = max(partitions_of(pages), -(-total // BUCKET_BYTES))
    responses = records.where("record_type = 'response'").select("page_id", "sha256", "header")
    write_buckets(responses.repartition(buckets, "sha256"), f"{root}/responses", "sha256", buckets)
    blobs = pages.select("html").mapInArrow(_blobs, _BLOB).repartition(buckets, "sha256").mapInArrow(_first_of_each, _BLOB)
    write_buckets(blobs, f"{root}/blobs", "sha256", buckets)
    forget(digests)


def _base32(hex_column: str) -> F.Column:
    """RFC 4648 base32 of a 40-digit hexadecimal column: five hex digits make four letters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = []
    for at in range(0, 40, 5):
        group = F.conv(F.substring(hex_column, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(alphabet), F.shiftright(group, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


_RECORD = "page_id long, record binary"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for sha256, header, blob in zip(*(batch.column(c).to_pylist() for c in ("sha256", "header", "blob")), strict=True):
            payload = unpack(blob) if blob is not None else None
            if payload is None or hashlib.sha256(payload).digest() != sha256:
                raise ValueError(f"the archive's payload {sha256.hex()} is missing or damaged")
            out.append(header + payload + RECORD_END)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.large_binary()).cast(pa.binary())], names=["page_id", "record"])


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """The original records of the archive: (page_id, record), the bytes of each whole WARC record.

    Only responses fetch their payload, from the bucket that both are stored in, so that nothing is shuffled; revisits
    have none in their record. A missing or damaged payload raises.
    """
    responses, blobs = read_buckets(spark, f"{root}/responses"), read_buckets(spark, f"{root}/blobs")
    fetched = responses.hint("shuffle_hash").join(blobs, "sha256", "left").select("page_id", "sha256", "header", "blob").mapInArrow(_assemble, _RECORD)
    revisits = spark.read.schema("page_id long, header binary").parquet(f"{root}/revisits")
    return fetched.union(revisits.select("page_id", F.concat("header", F.lit(bytearray(RECORD_END)))))


def parse_record(record: bytes) -> dict:
    """Header fields, HTTP head and payload of one WARC record; checks its lengths and its payload's digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != RECORD_END:
        raise ValueError("a record's length doesn't match its block")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a response's payload doesn't match its digest")
    return {"fields": fields, "http": http, "payload": payload, "payload_bytes": length, "payload_digest": digest}


_PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = lambda name: None if (n := name.removeprefix(f"<{RECORD_ID}").removesuffix(">")) == "null" else int(n)
    for batch in batches:
        found = [parse_record(r) for r in batch.column("record").to_pylist()]
        fields = [x["fields"] for x in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([own(f["WARC-Record-ID"]) for f in fields], pa.int64()),
                pa.array([x["payload_bytes"] for x in found], pa.int64()),
                pa.array([x["payload_digest"] for x in found], pa.string()),
                pa.array([f["WARC-Type"] for f in fields], pa.string()),
                pa.array([own(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None for f in fields], pa.int64()),
            ],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        )


def parsed(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records(record), all read from the bytes."""
    return records.select("record").mapInArrow(_parse, _PARSED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: write every page into an archive in the shared folder, read it back and describe the records."""
    pages = read(spark, sf_dir, "pages")
    root = f"{shared_dir(spark)}/shutterlake-warc-{uuid.uuid4().hex}"
    write_archive(pages, root)
    out = stored(parsed(read_archive(spark, root)), "warc")
    remove(spark, root)
    return out


SQL = """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) % 32 + 1, 1), '' ORDER BY i)
        FROM range(32) t(i)) AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM (SELECT page_id, html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
"""
