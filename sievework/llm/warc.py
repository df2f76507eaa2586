"""Content-addressed WARC archive: payload bytes stored once by SHA-256, exact record headers apart, records rebuilt by joins.

An archive is a folder with two Parquet tables: ``payloads`` (digest, payload) and ``headers`` (digest, header: the exact bytes of the
record's WARC header). Writing moves no payload but those of copies: the digests are grouped, and only rows whose digest was already
written by another row leave the payload table. Each of those is compared byte for byte with the stored payload, and reading computes
every digest anew, so neither a collision nor a damaged payload goes unseen.

Defined cases: a null payload is empty; a null url is an empty target; line ends in a url are percent-encoded; rows that repeat a
page_id with the same payload are written each, as records of that page; a null page_id never is the first of its copies unless all
are null; of equal payloads that tie for the smallest page_id (repeated rows) one brings the bytes; a very long payload is one value, hashed and compared like any other; an empty table gives empty tables;
other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, spread_join, written

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
CRLF = "\r\n"
URN = "urn:sievework:page:"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))


def _urn(i: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the archive of pages to path. date goes to WARC-Date."""
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    index = written(rows.select("page_id", "url", "n", "digest"), "warc-index")
    copies = index.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    copies = written(copies, "warc-copies")
    known = index.join(checked_broadcast(copies), "digest", "left")
    revisit = (F.col("n") >= LEAST_BYTES) & (F.col("first_id") != F.coalesce(F.col("page_id"), F.col("first_id") - 1))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", F.when(revisit, "revisit").otherwise(F.lit("response"))), _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", date), _line("WARC-Target-URI", target), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("first_id"))), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("Content-Type", "text/html"), _line("Content-Length", F.when(revisit, "0").otherwise(F.col("n").cast("string"))), F.lit(CRLF),
    )
    known.withColumn("revisit", F.coalesce(revisit, F.lit(False))).select("digest", F.encode(head, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # one row of a digest's copies brings the payload: the one with the smallest page_id; null ids and repeated ids are thinned below
    again = checked_broadcast(copies)
    joined = rows.select("page_id", "digest", "payload").join(again, "digest", "left")
    single = joined.filter(F.col("first_id").isNull() | (F.col("page_id") == F.col("first_id")))
    doubtful = written(index.join(again, "digest").filter(F.col("first_id").isNull() | (F.col("page_id") == F.col("first_id"))).groupBy("digest").count().filter("count > 1").select("digest"), "warc-repeated")
    if doubtful.isEmpty():
        stored = single.select("digest", "payload")
    else:
        twice = checked_broadcast(doubtful)
        stored = single.join(twice, "digest", "left_anti").select("digest", "payload").unionByName(single.join(twice, "digest", "left_semi").groupBy("digest").agg(F.first("payload").alias("payload")))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    if not copies.isEmpty():
        held = pages.sparkSession.read.parquet(f"{path}/payloads").join(again, "digest", "left_semi").withColumnRenamed("payload", "held")
        wrong = rows.join(again, "digest", "left_semi").join(held, "digest", "left").filter(~F.col("payload").eqNullSafe(F.col("held")))
        if not wrong.isEmpty():
            raise ValueError("two payloads with one SHA-256 digest")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archive: record_id, type, url, refers_to, digest (as computed from the stored bytes), payload (the full one, for revisits
    too) and record (the exact bytes of the original record). Fails on a payload whose digest isn't the one it is stored under."""
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("actual", F.sha2("payload", 256))
    headers = spark.read.parquet(f"{path}/headers")
    # a payload that a third of all records share has its copies of the bytes made in as many tasks
    rows = spread_join(headers, payloads, "digest", "header", headers.count(), "left").withColumn("head", F.decode("header", "UTF-8"))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))

    kind = field("WARC-Type")
    checked = F.when(F.col("actual") == F.regexp_extract("head", "\r\nWARC-Payload-Digest: sha256:([0-9a-f]+)\r\n", 1), F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("damaged or missing payload "), F.col("digest"))).cast("string"))
    number = lambda c: F.nullif(F.regexp_extract(c, rf"<{URN}(.*)>", 1), F.lit(""))
    block = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return rows.select(
        number(field("WARC-Record-ID")).alias("record_id"), kind.alias("type"), field("WARC-Target-URI").alias("url"), number(field("WARC-Refers-To")).alias("refers_to"),
        checked.alias("digest"), "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"),
    )
