"""Content-addressed WARC archive: payloads stored once by digest, headers kept beside them.

An archive is two Parquet tables in one folder. ``payloads`` has each distinct payload
once under its SHA-256; ``headers`` has the exact header block of every record with the
digest it points to. Records, as responses or as revisits, come back through a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
_EOL = "\r\n"


def base32(sha1_hex: Column) -> Column:
    """The bare base32 form of a SHA-1 given in hex: 40 bits, eight signs, at a time."""
    digits = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _payloads(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    body = F.coalesce(pages[payload_column].cast("binary"), F.lit("").cast("binary"))
    return pages.select(
        pages[id_column].cast("long").alias("page_id"), pages[url_column].alias("url"), body.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))


def _header(least: int) -> Column:
    """The WARC header block of a record, without the blank line that ends it."""
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "+")
    revisit = F.col("record_type") == "revisit"
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    other = F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), other)),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws(_EOL, *lines), F.lit(_EOL))


def write_archive(
    pages: DataFrame,
    path: str,
    least: int = 0,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
) -> None:
    """Archive every row: the payload under its digest, the record's header on its own.

    Of the rows with equal payloads of at least ``least`` bytes the one with the smallest
    id is a response and the others are revisits of it; smaller payloads are all responses.
    Equal means equal in SHA-256, SHA-1 and length. Copies are combined before any
    shuffle, so a payload that a third of all rows share is sent once per task.

    A null payload is empty. A null url gives an empty URI. Rows with a null id are
    responses. Rows that repeat the smallest id are all responses.
    """
    bodies = _payloads(pages, id_column, url_column, payload_column)
    bodies.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")
    records = bodies.select(
        "page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")
    )
    firsts = records.groupBy("digest").agg(F.min("page_id").alias("first"))
    revisit = (F.col("first") < F.col("page_id")) & (F.col("bytes") >= least)
    typed = (
        records.join(firsts, "digest")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first")))
    )
    typed.select("digest", "url", _header(least).alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record.

    Payloads are checked against their address as they are read, before the join; a stored
    payload that does not match, or a record whose payload is missing or has another digest
    than its header says, raises an error. Columns that are not selected, such as the payload itself, do
    not take part in the join. ``record`` is the record as a WARC file has it.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    stored = stored.select(
        "digest",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("found"),
        (F.sha2("payload", 256) == F.col("digest")).alias("intact"),
    )
    headers = spark.read.schema("digest string, url string, header string").parquet(f"{path}/headers")

    def field(name: str) -> Column:
        return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)

    def number(name: str) -> Column:
        return F.regexp_extract(field(name), r"(-?\d+)>", 1)

    parsed = headers.select(
        "digest",
        "url",
        "header",
        F.when(number("WARC-Record-ID") != "", number("WARC-Record-ID").cast("long")).alias("page_id"),
        field("WARC-Type").alias("record_type"),
        F.when(number("WARC-Refers-To") != "", number("WARC-Refers-To").cast("long")).alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("told"),
    )
    joined = parsed.join(stored, "digest", "left")
    sound = F.coalesce(F.col("intact") & (F.col("found") == F.col("told")), F.lit(False))
    checked = F.when(sound, F.col("told")).otherwise(
        F.raise_error(F.concat(F.lit("archive payload missing or damaged: "), F.col("digest")))
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    record = F.concat(
        F.concat(F.col("header"), F.lit(_EOL)).cast("binary"), body, F.lit(_EOL + _EOL).cast("binary")
    )
    return joined.select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        "payload_bytes",
        checked.alias("payload_digest"),
        "payload",
        record.alias("record"),
    )
