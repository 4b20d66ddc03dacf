"""WARC as a content-addressed archive: payloads once by digest, exact record headers beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32 (160 bits are 32 digits without padding)."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _BASE32HEX, _BASE32)


def _header(fields: list[tuple[str, Column]]) -> Column:
    lines = [F.lit("WARC/1.1")]
    for name, value in fields:
        lines.append(F.concat(F.lit(f"{name}: "), value))
    return F.concat_ws(CRLF, *lines)  # a NULL value leaves its line out


def _field(name: str) -> Column:
    # With (?d) only a line feed ends a line: U+0085, U+2028 and U+2029 are part of a value.
    found = F.regexp_extract("header", rf"(?md)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    min_revisit_bytes: int = 0,
) -> None:
    """Write one record per row below `path`: `headers` (record id, exact header text, payload digest) and
    `payloads` (each distinct payload once, keyed by its SHA-256).

    Of rows with equal payloads of at least `min_revisit_bytes` bytes, the one with the largest id is the
    `response`; the others are `revisit` records that refer to it and have no block of their own. All
    smaller payloads are responses. A NULL payload is an empty one, a NULL url leaves the target line out.
    Line breaks in a url are taken out of the header. Rows that repeat an id and payload are one record
    each; a row with a NULL id is a response of its own. Other columns are not read.

    Payload bytes are shuffled once, and only after equal ones within a task were reduced to one; all else is narrow,
    and the join on the digest is a plain one that is split at run time where a third of all rows are copies.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    stored = rows.groupBy("digest").agg(F.max(F.struct(F.octet_length("payload").alias("n"), "payload")).alias("p"))
    stored.select("digest", "p.payload").write.parquet(f"{path}/payloads")

    narrow = rows.select(
        "id", "url", "digest", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1")
    )
    newest = narrow.groupBy("digest").agg(F.max("id").alias("newest")).withColumnRenamed("digest", "_digest")
    told = narrow.join(newest, F.col("digest") == F.col("_digest"), "left")
    again = (F.col("n") >= min_revisit_bytes) & (F.col("id") < F.col("newest"))
    uri = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    url = F.regexp_replace("url", r"[\r\n]+", "")
    fields = [
        ("WARC-Type", F.when(again, "revisit").otherwise("response")),
        ("WARC-Record-ID", uri(F.col("id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Refers-To", F.when(again, uri(F.col("newest")))),
        (
            "WARC-Profile",
            F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
        ("X-Payload-Length", F.col("n").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("n").cast("string"))),
    ]
    told.select("id", "digest", _header(fields).alias("header")).write.parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per record from its header alone: id, record_type, url, refers_to, payload_bytes, payload_digest."""
    raw = spark.read.parquet(f"{path}/headers")
    number = lambda c: F.regexp_extract(c, r"<urn:record:(.*)>", 1).cast(raw.schema["id"].dataType)
    return raw.select(
        number(_field("WARC-Record-ID")).alias("id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        number(_field("WARC-Refers-To")).alias("refers_to"),
        _field("X-Payload-Length").cast("long").alias("payload_bytes"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        "digest",
        "header",
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records with their payloads joined back: the columns of `read_headers` with `payload`, `record` and `intact`.

    `record` is the exact record as bytes (header, blank line, block, two line ends); a revisit has an empty
    block, its full payload stands in `payload`. `intact` is true if payload, digests and lengths agree."""
    heads = read_headers(spark, path)
    stored = spark.read.parquet(f"{path}/payloads").withColumnRenamed("digest", "_digest")
    full = heads.join(stored, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    end = F.lit(CRLF * 2).cast("binary")
    intact = (
        (F.sha2("payload", 256) == F.col("digest"))
        & (F.octet_length("payload") == F.col("payload_bytes"))
        & (base32_sha1(F.col("payload")) == F.col("payload_digest"))
    )
    return full.withColumns(
        {
            "record": F.concat(F.col("header").cast("binary"), end, block, end),
            "intact": F.coalesce(intact, F.lit(False)),
        }
    )
