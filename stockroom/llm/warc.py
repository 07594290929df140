"""Content-addressed WARC archive.

The archive is two Parquet tables. ``payloads`` holds the bytes of each
distinct payload once, under its SHA-256; ``headers`` holds for each record
the exact bytes that come before the payload (WARC header and HTTP header) and
the payload's key. Of the records of one payload that with the largest page_id
is the response, the others are revisits that refer to it and carry no
payload, as WARC's identical-payload-digest profile has it.

``records`` joins both tables back to the original records, byte for byte, and
checks each payload against its key: a payload that does not hash to its key
fails the job. ``parse_record`` reads a record with no other knowledge.
``read_back`` parses all records and joins each, revisits too, to the payload
that it stands for: size, digest and reference must be the stored payload's.

The payload's SHA-256 decides equality; copies meet in one aggregation that
keeps one of them, combined before the shuffle, so a payload that a third of
all pages share moves once per task. Headers meet their payload's response id
in a salted join.

Defined cases: a null html is the empty payload; a null url is written as
``urn:page:`` and the id; line breaks in a url are percent-encoded; rows with
a null page_id are left out; a row that repeats a page_id is a record of its
own; other columns are not archived; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SALTS = 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are four times eight digits, so there is no padding."""
    digits = F.concat(*[
        F.lpad(F.conv(F.substring(F.sha1(payload), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def header_bytes(date: str) -> Column:
    """What comes before the payload, from page_id, url, digest, payload_bytes and response_id."""
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.coalesce(url, F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("page_id") != F.col("response_id")
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("response_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")))
    return F.concat(lines, F.lit("\r\n\r\n"), http).cast("binary")


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``path``/payloads (key, response_id, payload) and ``path``/headers (page_id, key, is_response, header)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.where("page_id is not null").select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    rows.groupBy("key").agg(F.max("page_id").alias("response_id"), F.any_value("payload").alias("payload")).write.option(
        "compression", "zstd").parquet(f"{path}/payloads")
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select(
        "key", "response_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    facts = rows.select("page_id", "url", "key", base32_sha1(F.col("payload")).alias("digest"),
                        F.octet_length("payload").cast("long").alias("payload_bytes"),
                        F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    facts.join(stored, ["key", "salt"]).select(
        "page_id", "key", (F.col("page_id") == F.col("response_id")).alias("is_response"),
        header_bytes(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def verified(payloads: DataFrame) -> DataFrame:
    """``payloads`` as stored; fails where bytes do not hash to their key."""
    ok = F.unhex(F.sha2("payload", 256)) == F.col("key")
    return payloads.withColumn("payload", F.when(ok, F.col("payload")).otherwise(
        F.raise_error(F.lit("a stored payload does not match its digest"))))


def records(spark: SparkSession, path: str, expand: bool = False) -> DataFrame:
    """(page_id, record, key): the bytes of every record. With ``expand`` also (payload), the full one for revisits too."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = verified(spark.read.parquet(f"{path}/payloads"))
    close = F.lit(END)
    if expand:
        joined = headers.join(payloads, "key")
        body = F.when(F.col("is_response"), F.col("payload")).otherwise(F.lit(b""))
        return joined.select("page_id", F.concat("header", body, close).alias("record"), "key", "payload")
    full = headers.where("is_response").join(payloads, "key").select(
        "page_id", F.concat("header", "payload", close).alias("record"), "key")
    return full.union(headers.where("not is_response").select("page_id", F.concat("header", close).alias("record"), "key"))


def parse_record(record: bytes) -> dict:
    """The parts of one WARC record of an HTTP response: headers (lower-case names), http, payload."""
    head, _, rest = record.partition(END)
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    named = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(named["content-length"])
    if rest[n:] != END:
        raise ValueError("a record's block does not end where its length says")
    http, _, payload = rest[:n].partition(END)
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (
        x.partition(b":") for x in http.split(b"\r\n")[1:])}
    return {"headers": named, "http": fields, "payload": payload}


def page_of(urn: str) -> int:
    return int(urn.removeprefix("<urn:page:").removesuffix(">"))


def parsed(found: DataFrame) -> DataFrame:
    """key, page_id, payload_bytes, payload_digest, record_type and refers_to, all but the key read from the records' bytes.

    A response's payload is counted and hashed, and must agree with its headers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for record in b.column(0):
                r = parse_record(record.as_py())
                h, size = r["headers"], int(r["http"]["content-length"])
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response":
                    own = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                    if (len(r["payload"]), own) != (size, digest):
                        raise ValueError("a record's payload does not agree with its headers")
                refers = h.get("warc-refers-to")
                rows.append((page_of(h["warc-record-id"]), size, digest, h["warc-type"], refers and page_of(refers)))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([b.column(1), *[pa.array(list(c), t) for c, t in zip(cols, types)]], names=["key", *names])

    return found.select("record", "key").mapInArrow(
        run, "key binary, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def describe(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records, from their bytes alone."""
    return parsed(found).drop("key")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """``describe`` of every record of an archive, each held against the stored payload that it stands for.

    Size and digest are the payload's own; a record that says otherwise, or refers to another response, fails the job."""
    facts = verified(spark.read.parquet(f"{path}/payloads")).select(
        "key", "response_id", F.octet_length("payload").cast("long").alias("own_bytes"),
        base32_sha1(F.col("payload")).alias("own_digest"))
    salted = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    said = parsed(records(spark, path)).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    agrees = ((F.col("payload_bytes") == F.col("own_bytes")) & (F.col("payload_digest") == F.col("own_digest"))
              & (F.coalesce("refers_to", "page_id") == F.col("response_id")))
    return said.join(salted, ["key", "salt"], "left").select(
        "page_id", F.col("own_bytes").alias("payload_bytes"), F.when(agrees, F.col("own_digest")).otherwise(
            F.raise_error(F.lit("a record disagrees with the payload it stands for"))).alias("payload_digest"),
        "record_type", "refers_to")


def new_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
