"""WARC archives with revisit resolution (operator 3).

Headers (digest, page_id, size) are shuffled by payload digest and aggregated
to the owner of each payload; pages join their owner, and each page becomes one
record of a deduplicated archive: ``response`` for the owner, ``revisit`` with
fresh headers for the others.  Every record is a gzip member of its own, so a
reader can start at any record.  Spark's text writer puts the members into
files, so the commit protocol covers lost executors and any file system that
Spark can write; what it puts behind each row is an empty gzip member.  Files
are bounded in bytes by the sizes in the headers.

Reading inflates one record at a time, finds its end by Content-Length,
recomputes the digest of every payload, and joins revisits to their original
responses.

Defined cases: a null html is an empty payload; empty payloads count as equal
like any other; a null page_id never owns a payload that another page has; rows
that share page_id and payload are all responses when they own it; white space
and control characters in a url become %20; an empty table gives an empty
archive; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a file, about: files of records of the mean size hold so many, those of the largest 16 times as many at most.
FILE_BYTES = 64 << 20
#: The empty gzip member behind each record, as ISO-8859-1 text.
EMPTY_MEMBER = (b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff\x03\x00" + bytes(8)).decode("latin-1")
INFLATE = 1 << 18


def base32(hexed: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: 20 bits become four letters."""
    alphabet, out = F.lit(BASE32), []
    for i in range(8):
        bits = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(alphabet, F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("null")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def headers(pages: DataFrame) -> DataFrame:
    """page_id, digest (hex), size: what is shuffled to find the owners."""
    return pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))


def resolve(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, payload, digest (hex), owner: the largest page_id with the same payload.

    The key is the bare hash, which is never null: for a key built from it Spark
    would add a null check that hashes the payload again for every part.
    """
    held = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1("payload"))
    # A written table, so that both sides of the join are plain shuffles: then a hot payload is split between tasks.
    each = headers(pages).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
    owners = scratch.keep(each, "owners")
    return held.join(owners.select("digest", "owner"), "digest")


def records_per_file(owners: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Records of a file by the mean and the largest size in the headers of all payloads."""
    mean, most = owners.agg(F.sum(F.col("size") * F.col("copies")) / F.sum("copies"), F.max("size")).first()
    return max(1, int(file_bytes / max(mean or 1, (most or 1) / 16, 512)))


def records(resolved: DataFrame, least: int = 0) -> DataFrame:
    """One column ``record``: header block, blank line and content of each page's WARC record."""
    size = F.octet_length("payload")
    own = F.col("page_id").eqNullSafe(F.col("owner")) | (size < least)
    http = lambda n: F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF * 2))
    block = F.concat(http(size), F.when(own, F.col("payload")).otherwise(F.lit("")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(own, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.length(uri) > 0, line("WARC-Target-URI", uri)).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("WARC-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(own, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", _record_id(F.col("owner"))), F.lit(f"WARC-Profile: {PROFILE}{CRLF}"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return resolved.select(F.concat(head, F.lit(CRLF), block).alias("record"))


def _member_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.column(0):
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(squeeze.compress(r.as_buffer()) + squeeze.compress(b"\r\n\r\n") + squeeze.flush())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write(record_rows: DataFrame, path: str, per_file: int) -> None:
    """Archives at ``path``: a gzip member for each record (which ends with CRLF CRLF), written by Spark."""
    members = record_rows.mapInArrow(_member_batches, "member binary")
    # Bytes cast to a string stay as they are, and the text writer writes them so.
    rows = members.select(F.col("member").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).option("maxRecordsPerFile", per_file).text(path)


def members(blob: memoryview) -> Iterator[bytes]:
    """The contents of the gzip members of an archive, one at a time; empty ones are left out."""
    at = 0
    while at < len(blob):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            part = blob[at : at + INFLATE]
            if not part:
                raise ValueError("an archive ends inside a record")
            out.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
        whole = b"".join(out)
        if whole:
            yield whole


def parse(blob) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers in lower case, content) of each record of one archive, gzipped (a member for one record or more) or not."""
    for whole in members(memoryview(blob)) if bytes(blob[:2]) == b"\x1f\x8b" else [bytes(blob)]:
        view, at = memoryview(whole), 0
        while at < len(whole):
            end = whole.index(b"\r\n\r\n", at)
            lines = whole[at:end].decode("utf-8").split(CRLF)
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record where one must start")
            head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            stop = end + 4 + int(head["content-length"])
            yield head, view[end + 4 : stop]
            if whole[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("a WARC record doesn't end where its length says")
            at = stop + 4


FIELDS = "page_id long, record_id string, record_type string, refers_to_id string, declared_digest string, payload_bytes long, payload_digest string, url string"


def payload_of(content: memoryview) -> memoryview:
    """What follows the HTTP header block."""
    for size in (512, 4096, len(content)):
        at = bytes(content[:size]).find(b"\r\n\r\n")
        if at >= 0:
            return content[at + 4 :]
    raise ValueError("no HTTP header block")


def _read_batches(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * with_payload
        types = [pa.int64() if n in ("page_id", "payload_bytes") else pa.binary() if n == "payload" else pa.string() for n in names]
        for batch in batches:
            for blob in batch.column(0):
                rows = []
                for head, content in parse(memoryview(blob.as_buffer())):
                    body = payload_of(content)
                    page = head.get("warc-page-id")
                    got = (int(page) if page is not None else None, head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), head["warc-payload-digest"].removeprefix("sha1:"), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), head.get("warc-target-uri"))
                    rows.append((*got, bytes(body)) if with_payload else got)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives at ``path``; ``payload_digest`` is computed from what was read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read_batches(with_payload), FIELDS + ", payload binary" * with_payload)


def follow(heads: DataFrame, scratch: Scratch) -> DataFrame:
    """Join revisits to the responses they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    wrong = F.when((F.col("record_type") == "response") & (F.col("payload_digest") != F.col("declared_digest")), F.raise_error(F.lit("a payload differs from its digest")))
    heads = heads.withColumn("declared_digest", F.coalesce(wrong.cast("string"), F.col("declared_digest")))
    originals = (
        heads.where("record_type = 'response'")
        .groupBy(F.col("declared_digest").alias("o_digest"), F.col("record_id").alias("o_id"))
        .agg(F.max("page_id").alias("o_page"), F.max("payload_bytes").alias("o_bytes"))
    )
    # A written table: the revisits of a hot payload are split between tasks.
    originals = scratch.keep(originals, "originals")
    met = heads.join(originals, (F.col("declared_digest") == F.col("o_digest")) & (F.coalesce("refers_to_id", "record_id") == F.col("o_id")), "left")
    revisit = F.col("record_type") == "revisit"
    return met.select(
        "page_id", F.coalesce("o_bytes", "payload_bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", F.when(revisit, F.col("o_page")).alias("refers_to")
    )


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as deduplicated archives at ``path``, read them back, and follow the revisits."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    path = path or scratch.path("archives")
    resolved = resolve(pages, scratch)
    write(records(resolved), path, records_per_file(spark.read.parquet(scratch.path("owners"))))
    return follow(scratch.keep(read(spark, path), "heads"), scratch)


ORACLE = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as h from p),
bits as (
  select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::bigint >> (15 - 5 * k)) & 31)::int + 1, 1), '' order by i, k) as payload_digest
  from (select distinct h from d), unnest(range(0, 8)) as u(i), unnest(range(0, 4)) as v(k) group by h),
o as (select *, max(page_id) over (partition by h) as owner from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id is not distinct from owner then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from owner then null else owner end as refers_to
from o join bits using (h)
"""
