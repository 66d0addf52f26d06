"""WARC as a content-addressed archive.

An archive is a folder with two Parquet tables. `payloads` holds each distinct payload once under its SHA-256; `headers` holds the exact
header block of every record, in bytes, with the digest of its payload. A record is rebuilt by joining the two and checking
the payload against its digest. Equal payloads of at least `min_bytes` are stored by one response; the other records
revisit it and refer to it; smaller ones are all responses (their payload is still stored once).

Payloads are merged map-side by digest before they are shuffled, so a group of copies, however large, moves as one
row a task. Headers never carry payloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MIN_BYTES = 100
#: Fixed values of the WARC 1.1 format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes one record for each row of `pages` (page_id, url, html); other columns are ignored.

    A null html is an empty payload, a null url an empty target. A null page_id never is a response that others refer to while
    another id has the payload. Rows that repeat both id and payload are one record each, of equal type. An empty table writes empty tables.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    stored = rows.groupBy("digest").agg(F.min("page_id").alias("winner"), F.count(F.lit(1)).alias("records"), F.first("payload").alias("payload"))
    stored.withColumn("payload_bytes", F.octet_length("payload").cast("long")).write.parquet(f"{path}/payloads")
    winners = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "winner", "payload_bytes")
    headers = rows.select("page_id", "url", "digest").join(winners, "digest")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    kind = F.when(revisit, "revisit").otherwise("response")
    # a target URI is one line
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("winner").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))), F.lit("\r\n"))
    headers.select(F.col("digest"), head.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: header fields, the full payload and the record's bytes, rebuilt by joins.

    Columns: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload, record. The digest and length are
    those of the stored bytes; a payload that doesn't match the digest in its record's header stops the read.
    page_id and refers_to are read as whole numbers; ids of other kinds come back null, as the header's text alone has them.
    Columns that aren't asked for aren't moved: without payload and record, the join carries digests and lengths only.
    """
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload", F.sha2("payload", 256).alias("actual"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    number = lambda name: F.regexp_extract(field(name), "([-0-9]+)>$", 1).try_cast("long")
    heads = spark.read.parquet(f"{path}/headers").select(
        "digest", "header", number("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("stated"))
    joined = heads.join(stored, "digest", "left")
    checked = F.when(F.col("stated") == F.col("actual"), F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest: "), F.col("stated"))))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", "url", "record_type", "refers_to", checked.alias("payload_digest"), "payload_bytes", "payload", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))
