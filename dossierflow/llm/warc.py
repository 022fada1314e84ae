"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header block of
each record is stored on its own. Records are put together again by a join
on the digest, after the stored bytes have been hashed anew and compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, delete, shared_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four characters."""
    code = F.sha1(payload)
    chars = []
    for group in range(8):
        bits = F.conv(F.substring(code, 5 * group + 1, 5), 16, 10).cast("int")
        for k in (15, 10, 5, 0):
            chars.append(F.substring(F.lit(BASE32), (F.shiftright(bits, k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write ``path/headers`` and ``path/payloads``, one WARC record per row of ``pages``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes that
    with the smallest id is a response, the others revisit it. Where several
    rows have that id, any one of them is the response. Null ids come last and have empty record ids; what revisits such
    a response has a null ``refers_to``. A null html is an empty payload, a
    null url an empty target. An empty table writes an empty archive; other
    columns are not stored.
    """
    payload = F.encode(F.coalesce(col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(col(id_col).cast("long").alias("page_id"), F.coalesce(col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    keys = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    keys = keys.withColumn("row", F.monotonically_increasing_id())  # tells repeated ids apart, and is fixed once written
    keys.write.parquet(f"{path}/index")
    spark = pages.sparkSession
    keys = spark.read.schema(keys.schema).parquet(f"{path}/index")
    row = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = keys.groupBy("sha256").agg(F.min(row).alias("first")).withColumnRenamed("sha256", "of")
    typed = keys.withColumn("own", row).join(first, F.col("sha256") == F.col("of"))
    revisit = (F.col("bytes") >= min_revisit_bytes) & ~F.col("own").eqNullSafe(F.col("first"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind,
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), number("page_id"),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Refers-To: <urn:page:"), number("first.page_id"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string"),
        F.lit(f"{CRLF}{CRLF}"),
    )
    typed.select("page_id", "sha256", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    # equal digests are merged ahead of the shuffle, so a frequent payload crosses it once from each task
    stored = rows.select(F.sha2("payload", 256).alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    delete(spark, f"{path}/index")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_type, refers_to, payload_sha1, payload, payload_bytes, payload_digest, header)``: every record, put together again.

    Ids, type and ``payload_sha1`` come from the header block. Bytes and
    digest (base32 SHA-1) are measured where a payload is stored, once for
    each, so who does not select ``payload`` moves no payload. A payload whose
    bytes no longer have the digest they are stored under is an error, as is
    a record without one or one whose header names another SHA-1.
    """
    headers = spark.read.schema("page_id bigint, sha256 string, header binary").parquet(f"{path}/headers")
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    intact = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("sha256"))))
    verified = stored.select(F.col("sha256").alias("of"), intact.alias("payload"))
    verified = verified.select("of", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    field = lambda name, body: F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"(?dm)^{name}: {body}\r$", 1), F.lit(""))
    records = headers.join(verified, headers["sha256"] == verified["of"], "left")
    checked = lambda c: F.when(F.col("payload_digest") == field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)"), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("no payload with the header's digest for "), F.col("sha256"))))
    return records.select(
        field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_sha1"),
        checked("payload").alias("payload"),
        checked("payload_bytes").alias("payload_bytes"),
        checked("payload_digest").alias("payload_digest"),
        "header",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """``(page_id, record)``: the whole WARC record of each row; a revisit has no body."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def archive_report(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh archive, read it back, and describe each record from what was read; see the two functions for odd rows."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
