"""A content-addressed archive of WARC records.

Writing: the exact header block of each record goes to one table, the payload bytes go to another, once
for each SHA-256 digest.  Of the records with equal payloads of at least `min_bytes` bytes the one with
the largest page_id is the response, and the others are revisit records that name it; smaller payloads are
always responses.  Reading: headers and payloads are joined on the digest, every payload is checked against
the digest that addresses it, and the original records (headers, payload, the two line ends) come back.

Defined cases: a null html is an empty payload; a null page_id orders last and its record id is "null"; of
repeated rows with one page_id and one payload the first copy counts as the largest and the others revisit
it; a null url becomes an empty target.  Line ends in a url are percent-encoded, so that headers stay
headers.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import delete_at_end, scratch_path

_HEX32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: Column) -> Column:
    """RFC 4648 base32 of 40 hexadecimal digits: four times ten digits become eight."""
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(sha1_hex, 10 * k + 1, 10), 16, 32), 8, "0"), _HEX32, _RFC32) for k in range(4)])


def _addressed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("payload"))
    return rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"), "payload")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write `path`/payloads and `path`/headers.  Only digests and ids are shuffled; payloads go straight to their file."""
    rows = _addressed(pages)
    keys = rows.select("page_id", "url", "digest", "sha1", "n").groupBy("digest", "sha1", "n", "page_id", "url").agg(F.count("*").alias("copies"))
    first = keys.groupBy("digest").agg(F.max(F.struct("page_id", "url", "copies")).alias("top"))
    # a digest with very many pages is one row on the right: Spark may split its left side freely
    keys = keys.join(first, "digest")
    head = (F.col("n") < min_bytes) | (F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url")))
    keys = keys.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    keys = keys.withColumn("response", (F.col("n") < min_bytes) | (head & (F.col("copy") == 1)))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: ")
    block = F.concat(http, F.col("n").cast("string"), F.lit(_CRLF * 2))
    length = F.octet_length(block).cast("long") + F.when(F.col("response"), F.col("n")).otherwise(F.lit(0))
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(F.col("response"), F.lit("response")).otherwise(F.lit("revisit"))), F.concat(F.lit("WARC-Record-ID: "), ident(F.col("page_id"))),
             F.lit(f"WARC-Date: {_DATE}"), F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1")))]
    lines += [F.when(~F.col("response"), F.concat(F.lit("WARC-Refers-To: "), ident(F.col("top.page_id")), F.lit(f"{_CRLF}WARC-Profile: {_PROFILE}")))]
    lines += [F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    header = F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block)
    keys.select("digest", "response", header.alias("header")).write.parquet(f"{path}/headers")
    # the row that carries the payload of its digest; repeated rows carry the same bytes, one of them is enough
    top = first.select(F.col("digest").alias("d"), F.col("top.page_id").alias("p"), F.col("top.url").alias("u"), F.col("top.copies").alias("c"))
    same = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u"))
    carried = rows.select("page_id", "url", "digest", "payload")
    once = carried.join(top.where("c = 1"), same, "left_semi").select("digest", "payload")
    more = carried.join(top.where("c > 1"), same, "left_semi").groupBy("digest").agg(F.first("payload").alias("payload"))
    once.union(more).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records: header block, whether it holds a payload of its own, the full payload and the record bytes as written.

    Also the SHA-1 (hexadecimal digits) and the size of the stored payload, taken where the payloads lie: a plan that
    asks for these alone moves no payload.  Fails if stored bytes do not have the digest that addresses them.
    """
    headers = spark.read.schema("digest string, response boolean, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    ok = F.sha2("payload", 256) == F.col("digest")
    payloads = payloads.select("digest", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("stored payload does not match "), F.col("digest")))).alias("payload"))
    payloads = payloads.select("*", F.sha1("payload").alias("payload_sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    record = F.concat(F.col("header").cast("binary"), F.when(F.col("response"), F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n"))
    return headers.join(payloads, "digest").select("header", "response", "payload", "payload_sha1", "payload_bytes", record.alias("record"))


def describe(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the records' own headers and stored payloads."""
    field = lambda name: F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:([^>]*)>', 1) as long)")
    out = records.select(field("WARC-Record-ID").alias("id"), field("WARC-Type").alias("record_type"), field("WARC-Refers-To").alias("to"), base32(F.col("payload_sha1")).alias("payload_digest"), "payload_bytes")
    return out.select(page("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page("to")).alias("refers_to"))


def archive(pages: DataFrame, name: str = "warc", min_bytes: int = 0) -> DataFrame:
    """Write an archive in the shared folder and read its records back; the files go when the driver ends.  (`write_archive` writes one that stays.)"""
    spark = pages.sparkSession
    path = scratch_path(spark, name)
    write_archive(pages, path, min_bytes)
    delete_at_end(spark, path)
    return read_archive(spark, path)
