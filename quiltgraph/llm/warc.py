r"""A content-addressed WARC archive.

``write_archive`` keeps two tables: ``payloads`` holds each distinct payload once,
under its SHA-256, and ``records`` holds every record's exact header block with
the digest it refers to. ``read_archive`` joins them on the digest, verifies
each stored payload against its key once, parses the header blocks, and
``record_bytes`` gives the original records back, byte for byte.

Of records whose payloads are equal and of ``least_bytes`` or more, that with the
smallest page_id is the response and the others are revisits that refer to it.

The role of a digest's records is found from (digest, salt) partial minima, so a
payload that a third of the pages share is spread over ``SALTS`` groups. Payloads are
shuffled once, after each task has dropped its own copies.

Defined results: null html is an empty payload; a null url is an empty target; a
row with a null page_id is a revisit of the smallest known id, or a response if
its group has none; rows that repeat the smallest page_id are all responses, their
payload stored once; an empty table gives an empty archive; other columns are
not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm.common import scratch_path

SALTS = 64
CRLF = "\r\n"
#: The digits of Java's radix 32 and those of RFC 4648.
RADIX_32, BASE_32 = "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex40: Column) -> Column:
    """Base-32 text of 40 hex digits: each five digits are four of base 32."""
    groups = [F.lpad(F.lower(F.conv(F.substring(hex40, 1 + 5 * g, 5), 16, 32)), 4, "0") for g in range(8)]
    return F.translate(F.concat(*groups), RADIX_32, BASE_32)


def _rows(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        base32(F.sha1(payload)).alias("sha1"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"),
    )


def _roles(rows: DataFrame, least_bytes: int) -> DataFrame:
    """For each (digest, salt): the smallest page_id among all salts."""
    parts = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "salt").agg(F.min("page_id").alias("first"))
    whole = parts.groupBy("digest").agg(F.min("first").alias("response_id"), F.collect_list("salt").alias("salts"))
    return whole.select("digest", "response_id", F.explode("salts").alias("salt"))


def _header(date: str) -> Column:
    """The header block, in the order and spelling in which it is written."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uuid = lambda key: F.regexp_replace(F.md5(key.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    record_id = lambda page: F.concat(F.lit("<urn:uuid:"), uuid(F.concat(F.lit("page/"), F.coalesce(page.cast("string"), F.lit("null")))), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", record_id(F.col("refers_to"))),
            line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        )).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("X-Page", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Archives ``pages`` (page_id, url, html) under ``path`` and returns it."""
    rows = _rows(pages)
    roles = _roles(rows, least_bytes)
    tagged = rows.join(roles, ["digest", "salt"], "left")
    first = F.col("response_id").isNull() | F.coalesce(F.col("page_id") == F.col("response_id"), F.lit(False))
    records = tagged.select("*", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("response_id")).alias("refers_to"))
    records.select("digest", "salt", _header(date).cast("binary").alias("header")).write.parquet(f"{path}/records")
    # Equal digests have equal payloads, so map-side combining leaves one of a task's copies before the shuffle.
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")
    return path


def _field(name: str) -> Column:
    """A header's value, or null."""
    text = F.col("header").cast("string")
    value = F.regexp_extract(text, f"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(text.contains(f"{CRLF}{name}: "), value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: header fields, and its payload by a join on the digest.

    ``verified`` says whether the stored payload still has the digest that is its key
    and the SHA-1 and length that the header states; it is found once for each payload.
    """
    store = spark.read.parquet(f"{path}/payloads").select(
        "digest", "payload",
        (F.sha2("payload", 256) == F.col("digest")).alias("intact"),
        base32(F.sha1("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    records = spark.read.parquet(f"{path}/records")
    salts = records.select("digest", "salt").distinct()  # so that a shared payload meets its records in many tasks
    store = salts.join(store, "digest")
    kind, digest = _field("WARC-Type"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    length = _field("Content-Length").try_cast("long")
    return records.join(store, ["digest", "salt"]).select(
        _field("X-Page").try_cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        _field("X-Refers-To-Page").try_cast("long").alias("refers_to"),
        digest.alias("payload_digest"),
        "payload_bytes",
        (F.col("intact") & (digest == F.col("sha1")) & (F.when(kind == "revisit", F.lit(0)).otherwise(F.col("payload_bytes")) == length)).alias("verified"),
        "header",
        "payload",
    )


def record_bytes(archive: DataFrame) -> DataFrame:
    """The exact records: header block, the payload unless it is a revisit, and the closing blank lines."""
    body = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return archive.withColumn("record", F.concat(F.col("header"), body, F.lit(CRLF * 2).cast("binary")))


def page_records(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the shared folder and reports the records read back."""
    spark = pages.sparkSession
    path = write_archive(pages, scratch_path(spark, "warc"))
    read = read_archive(spark, path)
    checked = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload fails its digest")).cast("string"))
    return read.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


PAGES_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
    array_to_string(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 AS INTEGER), 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
