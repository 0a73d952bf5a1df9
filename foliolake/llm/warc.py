"""WARC archives of pages, with revisit resolution.

Archives are written by Spark's text writer: one record per row, records ended by two line ends as the
format asks, gzip over the file. Spark's commit protocol keeps the output whole when executors are lost.
Records are read back by Spark's text reader, split at the line ends before the next version line, so
files split over tasks and memory is bounded by one record. A payload that holds that separator itself is
stored in two HTTP chunks cut inside it.

Revisits are resolved on headers alone: (page_id, digest, length) rows are grouped by payload digest with
partial aggregation, and payloads move once, to meet their decision by page_id.

Defined results: a null page is an empty payload, a null url leaves the target out, a null page_id leaves
the page number out and such a row never serves as the original. Rows that share a page_id and a payload
are alike: all of them are responses if they hold the smallest page_id. Payloads under ``LEAST_BYTES`` are
always responses. Other columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.common import checked_side, materialized, shared_folder

LEAST_BYTES = 100
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: What records are split at. It holds no prefix of itself but its last byte, so a reader that loses a
#: partial match at the end of its buffer never loses a separator.
SEPARATOR = "\n" + VERSION
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest (lower-case hex SHA-256), payload_bytes of every page."""
    payload = _payload(F.col("html"))
    return pages.select(
        "page_id",
        F.sha2(payload, 256).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )


def originals(heads: DataFrame) -> DataFrame:
    """payload_digest and the smallest page_id of payloads that several rows share."""
    return (
        heads.filter(f"payload_bytes >= {LEAST_BYTES}")
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
        .filter("n > 1 AND original IS NOT NULL")
        .select("payload_digest", "original")
    )


def decisions(pages: DataFrame) -> DataFrame:
    """page_id and refers_to of the rows that become revisits (one row per page_id and payload)."""
    heads = headers(pages)
    shared, rows = materialized(originals(heads))
    return (
        heads.join(checked_side(shared, rows), "payload_digest")
        .filter("page_id IS NULL OR page_id <> original")
        .select("page_id", "payload_digest", F.col("original").alias("refers_to"))
        .distinct()
    )


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line ends inside the value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *parts))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        F.lit(">"),
    )


def _http(payload: Column) -> Column:
    """An HTTP answer whose body never shows the record separator."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    plain = F.concat(
        F.lit(head + "Content-Length: "), F.octet_length(payload).cast("string"), F.lit(END), payload
    )
    pieces = F.split(payload, r"(?<=\nWAR)(?=C/1\.1\r\n)")
    chunks = F.array_join(
        F.transform(pieces, lambda p: F.concat(F.hex(F.octet_length(p)), F.lit("\r\n"), p, F.lit("\r\n"))), ""
    )
    chunked = F.concat(F.lit(head + "Transfer-Encoding: chunked\r\n\r\n"), chunks, F.lit("0\r\n"))
    return F.when(F.contains(payload, F.lit(SEPARATOR)), chunked).otherwise(plain)


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record per page without its ending, responses with payload and revisits without."""
    payload = _payload(F.col("html"))
    digest = F.sha2(payload, 256)
    decided = decisions(pages).withColumnsRenamed({"page_id": "_page", "payload_digest": "_digest"})
    rows = pages.select("page_id", "url", "html").withColumn("payload_digest", digest)
    # Rows meet their decision by page_id; the digest only tells rows apart that share an id.
    joined = rows.join(
        decided, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left"
    )
    revisit = F.col("refers_to").isNotNull()
    page = F.col("page_id").cast("string")
    block = F.when(revisit, F.lit("")).otherwise(_http(payload))
    return joined.select(
        F.concat(
            F.lit(VERSION),
            _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            _field("WARC-Record-ID", _uuid(F.lit("page"), page, F.col("payload_digest"))),
            _field("WARC-Date", F.lit(date)),
            _field("WARC-Target-URI", F.col("url")),
            _field("WARC-Page-ID", page),
            _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
            _field("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            _field("WARC-Refers-To", F.when(revisit, _uuid(F.lit("page"), F.col("refers_to").cast("string"), F.col("payload_digest")))),
            _field("WARC-Refers-To-Page-ID", F.col("refers_to")),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            _field("Content-Length", F.octet_length(block)),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the deduplicated archives of ``pages`` to a new folder on any file system Spark knows."""
    records(pages, date).write.option("lineSep", END).option("compression", "gzip").text(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Header fields and blocks of all records below ``folder``.

    Columns: page_id, url, record_type, payload_digest, refers_to, content_length, block, payload (null for
    revisits). ``complete`` is false where the block is not as long as its header says.
    """
    text = spark.read.option("lineSep", SEPARATOR).text(folder).filter("value <> ''")
    # The first record of a file still has its version line, which is no header field.
    parts = text.select(
        F.concat(F.lit("\r\n"), F.expr("left(value, locate('\\r\\n\\r\\n', value) - 1)"), F.lit("\r\n")).alias("head"),
        F.expr("substring(value, locate('\\r\\n\\r\\n', value) + 4)").alias("rest"),
    )

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))

    named = parts.select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("Content-Length").cast("long").alias("content_length"),
        "rest",
    )
    # The ending of a record, of which the separator has taken the last byte where another record follows.
    extra = (F.octet_length("rest") - F.col("content_length")).cast("int")
    ends = F.endswith("rest", F.lit(END[:-1])) | F.endswith("rest", F.lit(END))
    block = F.when(extra.isin(3, 4) & ends, F.left("rest", F.length("rest") - extra)).otherwise(F.col("rest"))
    named = named.withColumn("block", block).drop("rest")
    body = F.expr("substring(block, locate('\\r\\n\\r\\n', block) + 4)")
    is_chunked = F.contains(F.expr("left(block, 200)"), F.lit("\r\nTransfer-Encoding: chunked\r\n"))
    return named.select(
        "*",
        (F.octet_length("block") == F.col("content_length")).alias("complete"),
        F.when(F.col("record_type") == "response", F.when(is_chunked, _unchunked(body)).otherwise(body)).alias("payload"),
    )


def _unchunked(body: Column) -> Column:
    """The chunks cut inside the separator put together again."""
    joined = F.regexp_replace(body, r"(?<=\nWAR)\r\n[0-9A-F]+\r\n(?=C/1\.1\r\n)", "")
    return F.regexp_replace(F.regexp_replace(joined, r"^[0-9A-F]+\r\n", ""), r"\r\n0\r\n$", "")


def resolved(archive: DataFrame) -> DataFrame:
    """Records read back, with payload size and digest taken from stored payloads.

    A response is measured itself; a revisit takes both from the response that it refers to.
    """
    heads = archive.select(
        "page_id", "record_type", "refers_to",
        F.coalesce("payload_digest", F.lit("")).alias("stated_digest"),
        F.octet_length("payload").cast("long").alias("own_bytes"),
        F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("own_digest"),
    )
    stored = heads.filter("record_type = 'response'").groupBy("stated_digest", F.col("page_id").alias("refers_to")).agg(
        F.first("own_bytes").alias("original_bytes"), F.first("own_digest").alias("original_digest")
    )
    stored, rows = materialized(stored)
    revisits = heads.filter("record_type = 'revisit'").join(
        checked_side(stored, rows), ["stated_digest", "refers_to"], "left"
    )
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = heads.filter("record_type = 'response'").withColumnsRenamed(
        {"own_bytes": "payload_bytes", "own_digest": "payload_digest"}
    )
    revisits = revisits.withColumnsRenamed({"original_bytes": "payload_bytes", "original_digest": "payload_digest"})
    return responses.select(*columns).unionByName(revisits.select(*columns))


def archived_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives of ``pages``, read them back and resolve the revisits."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_archives(pages, folder)
    return resolved(read_records(spark, folder))
