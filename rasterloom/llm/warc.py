"""A content-addressed web archive.

Two tables: ``payloads`` holds each distinct payload once under its SHA-256, ``headers``
holds for every record the exact bytes that precede the payload (the WARC header block and
the HTTP header block) and the payload's key.  Original records come back by a join.  Digests
are verified when the archive is written (rows of one key must agree in size and in their
SHA-1 too) and when it is read (a payload must have its key's digest).

Everything is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, scratch_dir

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one payload from which its headers are dealt into parts.
HOT = 1000


def base32(hex_digest: Column) -> Column:
    """Base32 (RFC 4648) of a hexadecimal digest whose bits are a multiple of 20."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_urn(number: Column) -> Column:
    """A URN with the 64 bits of a record's number; null has one of its own."""
    h = F.lower(F.lpad(F.hex(number), 16, "0"))
    made = F.concat(
        F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 13, 3),
        F.lit("-8"), F.substring(h, 16, 1), F.lit("00-000000000000"),
    )
    return F.coalesce(made, F.lit("urn:uuid:00000000-0000-4000-8000-ffffffffffff"))


def urn_number(urn: Column) -> Column:
    """The number in a URN of ``record_urn``; null for that of null."""
    h = F.concat(F.substring(urn, 10, 8), F.substring(urn, 19, 4), F.substring(urn, 25, 3), F.substring(urn, 30, 1))
    number = F.conv(h, 16, -10).cast("long")
    return F.when(urn.endswith("ffffffffffff"), F.lit(None).cast("long")).otherwise(number)


def _lines(*lines: Column) -> Column:
    return F.concat(*[F.concat(x, F.lit("\r\n")) for x in lines], F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, hot: int = HOT) -> None:
    """Write a record per row to ``path``/headers and each payload once to ``path``/payloads.

    Of the records with one payload of at least ``least_bytes`` bytes, those with the
    largest id are responses and the others revisits that refer to it; smaller payloads are
    all responses.  A null payload is empty.  A null id counts as smaller than any other.
    Repeated rows are records of their own.  White space and control characters in a URL
    become %20; a null URL is ``about:blank``.  Other columns play no part.  An empty table
    gives an empty archive.

    Both tables are bucketed by key, so that a payload moves once, when copies are dropped,
    and meets its headers where it lies.  ``part`` deals the headers of a payload
    of more than ``hot`` records into parts of about that size and is null elsewhere.
    """
    text = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), text.alias("payload"))
    rows = rows.withColumn("key", F.sha2(F.col("payload").cast("binary"), 256))
    slim = rows.select("id", "url", "key", base32(F.sha1(F.col("payload").cast("binary"))).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    slim = cut(slim, "records")
    alike = (F.min("digest") == F.max("digest")) & (F.min("bytes") == F.max("bytes"))
    parts = F.when(alike, F.ceil(F.count("*") / hot)).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("long"))
    top = slim.groupBy("key").agg(F.max("id").alias("holder"), parts.alias("parts"))
    r = slim.join(top, "key").withColumn("first", (F.col("bytes") < least_bytes) | F.col("id").eqNullSafe(F.col("holder")))
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    size = F.octet_length(http) + F.when(F.col("first"), F.col("bytes")).otherwise(0)
    about = F.when(F.col("first"), F.lit("WARC-Type: response")).otherwise(
        F.concat(F.lit(f"WARC-Type: revisit\r\nWARC-Profile: {REVISIT}\r\nWARC-Refers-To: <"), record_urn(F.col("holder")), F.lit(">"))
    )
    head = _lines(
        F.lit("WARC/1.1"), about, F.concat(F.lit("WARC-Record-ID: <"), record_urn(F.col("id")), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), url), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), size.cast("string")),
    )
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", "url"), F.col("parts")).cast("int"))
    headers = r.select("key", F.concat(head, http).alias("header"), F.col("first").alias("has_payload"), part.alias("part"), (F.col("parts") > 1).cast("int").alias("hot"))
    _save(headers, f"{path}/headers", "hot")
    _save(rows.select("key", "payload").dropDuplicates(["key"]), f"{path}/payloads")


def _table(path: str) -> str:
    return f"archive_{hashlib.md5(path.encode()).hexdigest()}"


def _save(df: DataFrame, path: str, *partitions: str) -> None:
    """Write compressed Parquet to ``path``, registered as a table bucketed by ``key``.

    There are as many buckets as shuffle partitions, so a table shuffled by key is
    written a bucket a task, and a bucketed table need not be shuffled to meet it.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "key")
    (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(_table(path))


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of an archive; a payload that doesn't match its key is an error.

    Where the session's catalogue knows the tables, their buckets spare a shuffle.
    """

    def read(name: str, schema: str) -> DataFrame:
        table = _table(f"{path}/{name}")
        return spark.table(table) if spark.catalog.tableExists(table) else spark.read.schema(schema).parquet(f"{path}/{name}")

    stored = read("payloads", "key string, payload string")
    same = F.sha2(F.col("payload").cast("binary"), 256) == F.col("key")
    payload = F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't match its digest")).cast("string"))
    headers = read("headers", "key string, header string, has_payload boolean, part int, hot int")
    return headers, stored.select("key", payload.alias("payload"))


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Whole records: ``record`` as it stands in a WARC file, and its full ``payload``.

    A payload of very many records is copied for each part of its headers.
    """
    end = F.lit("\r\n\r\n")
    record = F.when(F.col("has_payload"), F.concat("header", "payload", end)).otherwise(F.concat("header", end))
    both = headers.where("hot = 0").join(payloads, "key").select(record.alias("record"), "payload")
    many = headers.where("hot = 1")
    if many.isEmpty():
        return both
    fan = many.groupBy("key").agg(F.max("part").alias("last"))
    copies = payloads.join(fan, "key").select("key", "payload", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    spread = many.repartition("key", "part").join(copies, ["key", "part"])
    return both.union(spread.select(record.alias("record"), "payload"))


def export(rows: DataFrame, path: str) -> None:
    """Write ``record`` to plain WARC files by Spark's own text writer."""
    rows.select(F.expr("substring(record, 1, length(record) - 1)")).write.option("lineSep", "\n").text(path)


def fields(rows: DataFrame) -> DataFrame:
    """What the records say: id, payload size and digest, type, id of the record referred to.

    The digest is that of the payload; if the record's header has another, that is an error.
    """
    head = F.substring_index("record", "\r\n\r\n", 1)
    field = lambda name: F.regexp_extract(head, rf"\r\n{name}: <?([^\r>]*)", 1)
    digest = base32(F.sha1(F.col("payload").cast("binary")))
    sound = F.when(digest == field("WARC-Payload-Digest").substr(F.lit(6), F.lit(32)), digest).otherwise(F.raise_error(F.lit("a record has another digest than its payload")).cast("string"))
    refers = field("WARC-Refers-To")
    return rows.select(
        urn_number(field("WARC-Record-ID")).alias("id"), F.octet_length("payload").cast("long").alias("payload_bytes"), sound.alias("payload_digest"),
        field("WARC-Type").alias("record_type"), F.when(refers != "", urn_number(refers)).alias("refers_to"),
    )


def round_trip(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write an archive (to the shared folder if no path is given) and read its records."""
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, path, **how)
    return fields(records(*read_archive(spark, path)))
