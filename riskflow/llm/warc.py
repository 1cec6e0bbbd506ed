"""Content-addressed WARC archive.

An archive folder holds two tables. `payloads` has every distinct payload once under its SHA-256; `headers` has the
exact bytes of each record's WARC header and HTTP header, and the digest that leads to the payload. Original records
come back from a join of the two, and every stored payload is hashed again when it is read.

Rules: a null payload is empty. Records with equal payloads of at least `min_bytes` bytes refer to the one with the
smallest id: it is the response, the others are revisits. Shorter payloads are responses throughout. A row that
repeats the smallest id is a response as well; a null id never becomes the response unless all ids of the group are
null. A null url has no WARC-Target-URI line; control characters in a url are percent-encoded. Other columns of the
input are not archived. An empty input gives two empty tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def _line(name, value):
    """A header line; no line at all for a null value."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def _urn(key):
    return F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))


def _records(pages, key, url, payload):
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"),
                        F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))


def write_archive(pages: DataFrame, folder: str, key="page_id", url="url", payload="html", min_bytes=100,
                  date=EPOCH) -> None:
    """Archives every row of `pages` below `folder`.

    Copies of a payload meet before the shuffle (map-side aggregation by digest), so a payload that a third of all
    rows share crosses the network once per map task.
    """
    spark = pages.sparkSession
    records = _records(pages, key, url, payload)
    (records.groupBy("digest").agg(F.min("id").alias("first_id"), F.any_value("payload").alias("payload"))
     .write.option("compression", "zstd").parquet(f"{folder}/payloads"))
    firsts = spark.read.parquet(f"{folder}/payloads").select("digest", "first_id")
    rows = records.drop("payload").join(firsts, "digest")
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF),
                    _line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    safe_url = F.col("url")
    for c in map(chr, [*range(32), 127]):
        safe_url = F.replace(safe_url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    block = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    warc = F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", safe_url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.col("first_id")))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(REVISIT_PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        _line("Content-Length", block.cast("string")), F.lit(CRLF))
    (rows.withColumn("revisit", revisit).withColumn("http", http)
     .select("digest", warc.cast("binary").alias("warc_header"), F.col("http").cast("binary").alias("http_header"))
     .write.option("compression", "zstd").parquet(f"{folder}/headers"))


def _field(name, pattern):
    text = F.concat(F.lit("\n"), F.col("warc_header").cast("string"))
    return F.nullif(F.regexp_extract(text, rf"\n{name}: {pattern}\r", 1), F.lit(""))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per archived record, read from the archive alone.

    `page_id`, `record_type`, `refers_to` and `target_uri` are parsed from the exact header; `payload`,
    `payload_bytes` and `payload_digest` come from the stored payload, `verified` says whether the digest of the
    stored bytes is the one the header names; `record` is the original record, byte by byte. What a reader does not
    select is not shuffled.
    """
    body = F.col("payload")
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        "digest", body, F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    headers = spark.read.parquet(f"{folder}/headers").withColumn("named", _field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})"))
    kind = _field("WARC-Type", "([a-z]+)")
    sent = F.when(kind == "response", body).otherwise(F.lit(b""))
    return headers.join(payloads, "digest", "left").select(
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"), kind.alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        _field("WARC-Target-URI", "([^\r]*)").alias("target_uri"), "payload_bytes", "payload_digest",
        F.coalesce(F.col("payload_digest") == F.col("named"), F.lit(False)).alias("verified"), body,
        F.concat("warc_header", "http_header", sent, F.lit(b"\r\n\r\n")).alias("record"))
