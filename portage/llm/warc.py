"""Content-addressed WARC archive: payload bytes once per SHA-256, exact record headers beside them, joined on reading.

The archive is two Parquet tables. ``payloads`` has each distinct payload once, keyed by its SHA-256. ``records`` has
for every record its exact header bytes (WARC header and HTTP header) and the key of its payload. A record is its
header, its payload if it is a response, and two line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Smaller payloads are always written as responses.
REVISIT_BYTES = 1000
# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))



def plan_records(pages: DataFrame) -> DataFrame:
    """One row per distinct (page_id, url, payload): sha256, sha1, bytes, copies, record_type and refers_to.

    Only digests are shuffled. The largest page_id of each payload comes from a partial maximum, so a payload that very
    many pages share is no hot group. Equal rows of one page and url are ``copies``; one row of a payload ``stores`` it.
    """
    digests = pages.select(
        "page_id", F.sha2(_payload(F.col("html")), 256).alias("sha256"), F.sha1(_payload(F.col("html"))).alias("sha1"),
        F.octet_length(_payload(F.col("html"))).cast("long").alias("bytes"), F.col("url").cast("string").alias("url"),
    )
    digests = digests.groupBy("page_id", "sha256", "sha1", "bytes", "url").agg(F.count("*").alias("copies"))
    newest = digests.groupBy("sha256").agg(F.max(F.struct("page_id", "url")).alias("stored"))
    newest = newest.select("sha256", F.col("stored.page_id").alias("newest"), F.col("stored.url").alias("stored_url"))
    joined = digests.join(newest, "sha256")
    is_first = F.col("page_id").eqNullSafe(F.col("newest"))
    revisit = (F.col("bytes") >= REVISIT_BYTES) & ~is_first
    return joined.select(
        "page_id", "sha256", "sha1", "bytes", "url", "copies",
        (is_first & F.col("url").eqNullSafe(F.col("stored_url"))).alias("stores"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("newest")).alias("refers_to"),
    )


def record_header(date: str) -> Column:
    """The exact header text of a planned record, up to where its payload begins."""
    http = F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}")
    http = F.concat(http, F.lit("Content-Length: "), F.col("bytes").cast("string"), F.lit(_END + _END))
    is_revisit = F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("bytes"))
    # Line ends in an address would end the header line.
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(is_revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}{_END}WARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END), http)


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (page_id, url, html).

    Of equal payloads of at least 1000 bytes, the page with the largest page_id is a response, the others revisit it.
    Null html is an empty payload, a null page_id an empty id and smaller than any other. Equal rows of one page become
    equal records, and records of one page_id share their WARC-Record-ID. In addresses, line ends become spaces and null
    becomes empty; payloads come back as they were. Payloads travel to the row that stores them in one shuffle by (page_id, sha256).
    """
    spark = pages.sparkSession
    plan_path = f"{path}/plan"
    plan_records(pages).write.parquet(plan_path)
    plan = spark.read.parquet(plan_path)
    records = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    records.select("sha256", record_header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")

    # Plain keys without nulls: the join and the window then share one shuffle of the payloads.
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    key = F.sha2(_payload(F.col("html")), 256)
    contents = pages.select(page.alias("_page"), key.alias("_key"), F.col("html").alias("_html"))
    stores = plan.where("stores").select(page.alias("_page"), F.col("sha256").alias("_key"))
    held = contents.join(stores, ["_page", "_key"], "left_semi")
    # Equal rows of one page are the only ones left with one key; each key lies whole in the partitions of the join.
    once = Window.partitionBy("_page", "_key").orderBy("_page")
    held = held.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    held.select(F.col("_key").alias("sha256"), _payload(F.col("_html")).alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header, payload, payload_bytes, payload_sha1 and record (exact bytes) of every record.

    Every stored payload's SHA-256 is computed again and must be its key; a record whose payload is missing fails too.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    intact = F.assert_true(F.sha2("payload", 256) == F.col("sha256"), "a payload is not what its digest says").isNull()
    payloads = payloads.where(intact).select(
        "sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_sha1"),
    )
    records = spark.read.parquet(f"{path}/records")
    joined = records.join(payloads, "sha256", "left")
    there = F.assert_true(F.col("payload_bytes").isNotNull(), "a record's payload is missing").isNull()
    block = F.when(header_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.where(there).select(
        "header", "payload", "payload_bytes", "payload_sha1",
        F.concat(F.encode("header", "UTF-8"), block, F.lit((_END + _END).encode())).alias("record"),
    )


def header_field(name: str) -> Column:
    """Value of the first header line ``name``, null where there is none."""
    value = F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def page_of(field: Column) -> Column:
    return F.regexp_extract(field, "^<urn:page:(.*)>$", 1)


def read_page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, all from the archive's bytes."""
    records = read_archive(spark, path)
    page, refers = page_of(header_field("WARC-Record-ID")), page_of(header_field("WARC-Refers-To"))
    digest = F.regexp_extract(header_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    right = F.assert_true(digest == F.col("payload_sha1"), "a header's digest is not its payload's").isNull()
    return records.where(right).select(
        F.when(page != "", page).cast("long").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )
