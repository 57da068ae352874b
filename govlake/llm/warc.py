"""A content-addressed WARC archive.

``payloads`` holds the bytes of each distinct payload once, under their SHA-256; ``headers`` holds
the exact header bytes of every record and the digest of its payload. Records are put together by
joining the two, and each payload is checked against its key as it is read. ``export_warc``
writes plain WARC files, ``read_warc`` reads such files.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the largest page_id is a
``response`` and the others are ``revisit`` records that refer to it.

Nulls: a null payload is empty, a null url leaves its header out; a null page_id loses against any
other and reads back as null. Rows that repeat, page_id included, give equal records. An empty
table gives an empty archive. Other columns are ignored, whatever their names. Payloads may hold any
bytes; a payload is one value, so it has to fit a row. Page ids of any characters read back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm.common import Scratch, attach

REVISIT_BYTES = 1000
EOL = "\r\n"
URN, NO_URN = "urn:x-page:", "urn:x-no-page"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    spark: SparkSession
    path: str
    id_type: str

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.schema("header binary, key binary").parquet(f"{self.path}/headers")

    @property
    def payloads(self) -> DataFrame:
        """key and payload; a payload that does not match its key stops the job."""
        stored = self.spark.read.schema("key binary, payload binary").parquet(f"{self.path}/payloads")
        right = F.unhex(F.sha2("payload", 256)) == F.col("key")
        return stored.select("key", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest"))).alias("payload"))


def _field(name: str, value: Column) -> Column:
    """A header line; none where the value is null. White space and control characters in values cannot end the line."""
    clean = F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(EOL)), F.lit(""))


def write_archive(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", path: str | None = None) -> Archive:
    """Archive ``pages`` (page_id, url, html), a record per row."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = path or scratch.path("archive")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    records = scratch.write(rows.select("page_id", "url", "key", F.length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1")), "records")
    groups = scratch.write(records.groupBy("key").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("rows")), "groups")
    # by digest and page: copies of a common payload go to many tasks, and one copy stays
    keeper = groups.select(F.col("key").alias("_key"), F.col("response_id").alias("_id"))
    stored = rows.join(keeper, (F.col("key") == F.col("_key")) & F.col("page_id").eqNullSafe(F.col("_id")), "left_semi")
    if records.groupBy("key", "page_id").count().filter("count > 1").limit(1).count():  # rows that repeat with their page_id
        stored = stored.dropDuplicates(["key", "page_id"])
    stored.select("key", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    known = attach(records, groups, ["key"], "rows")
    revisit = (F.col("bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    urn = lambda c: F.coalesce(F.concat(F.lit(f"<{URN}"), F.url_encode(c.cast("string")), F.lit(">")), F.lit(f"<{NO_URN}>"))
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(revisit, urn(F.col("response_id")))),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(EOL),
    )
    known.select(header.cast("binary").alias("header"), "key").write.option("compression", "zstd").parquet(f"{path}/headers")
    scratch.drop("records", "groups")
    return Archive(spark, path, pages.schema["page_id"].dataType.simpleString())


def _value(name: str) -> Column:
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def _page(urn: Column, id_type: str) -> Column:
    """The page_id in a record's name, as it was; null where the page had none."""
    return F.when(urn.startswith(f"<{URN}"), F.url_decode(F.regexp_extract(urn, rf"^<{URN}(.*)>$", 1))).try_cast(id_type)


def read_records(archive: Archive) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of every record, the last two from the payload that it or its response holds."""
    scratch = Scratch(archive.spark, "records")
    records = scratch.write(
        archive.headers.select(_page(_value("WARC-Record-ID"), archive.id_type).alias("page_id"), _value("WARC-Type").alias("record_type"), _page(_value("WARC-Refers-To"), archive.id_type).alias("refers_to"), _value("WARC-Payload-Digest").alias("_digest"), _value("Content-Length").cast("long").alias("_length"), "key"),
        "heads",
    )
    used = records.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    facts = archive.payloads.select("key", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    known = scratch.write(facts.join(used, "key"), "facts")
    whole = attach(records, known, ["key"], "rows")
    block = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))  # a revisit's is empty
    right = F.col("_digest").eqNullSafe(F.concat(F.lit("sha1:"), "payload_digest")) & F.col("_length").eqNullSafe(block)
    checked = F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record does not match its payload")))
    out = scratch.write(whole.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to"), "records")
    scratch.drop("heads", "facts")
    return out


def reconstruct(archive: Archive) -> DataFrame:
    """header and payload bytes of every record, as they were; a revisit has its response's payload."""
    return archive.headers.join(archive.payloads, "key").select("header", "payload")


def export_warc(archive: Archive, path: str, gzip: bool = True, most_records: int = 20_000) -> None:
    """WARC files of at most ``most_records`` records: the text writer's separator is what ends a record, and it writes bytes as they are."""
    block = F.when(_value("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    records = reconstruct(archive).select(F.concat("header", block).cast("string").alias("value"))
    records.write.option("maxRecordsPerFile", most_records).option("lineSep", EOL + EOL).option("compression", "gzip" if gzip else "none").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header and block of every record in the files below ``path``, cut by Content-Length.

    A file is one row and is unpacked in memory, so files have to be of moderate size (``export_warc`` bounds their records).
    """
    import gzip as gz
    import re

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                data = gz.decompress(data) if data[:2] == b"\x1f\x8b" else data
                heads, blocks, at = [], [], 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", data[at:end])[1])
                    heads.append(data[at:end])
                    blocks.append(data[end : end + size])
                    at = end + size + 4
                yield pa.RecordBatch.from_pydict({"header": pa.array(heads, pa.binary()), "block": pa.array(blocks, pa.binary())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, block binary")
