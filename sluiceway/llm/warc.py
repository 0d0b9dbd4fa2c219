"""WARC archives with content-addressed payloads.

Writing: of records with equal payloads (of at least a given size) one holds the payload and the others are revisits of
it.  Reading: records are parsed by their declared lengths and a payload's digests are computed anew and compared.  An archive
is two tables: payloads, each kept once by SHA-256, and the exact headers of each record; joins put the records together.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, scratch, small, tidy

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 1000
#: A file is parsed in one piece, so it has at most 64 MB, or one record: records up to so many bytes go so many to a file.
FILES = ((1 << 14, 4000), (1 << 20, 64), (1 << 63, 1))
#: The lines of a record but for its address and its date take fewer bytes than this.
HEAD_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
#: Broadcast a list of digests up to so many rows (under 50 MB), else shuffle.
BROADCAST_ROWS = 500_000
#: A payload of more records than this is dealt to several tasks.
HOT_PAYLOAD = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, warc_header string, http_header string, sha1 string, sha256 string, payload string"


def room(date: str = "") -> Column:
    """An upper bound of the bytes of a page's record, from the lengths of its columns alone."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return size("html") + 3 * size("url") + HEAD_BYTES + len(date)


def records(pages: DataFrame, least: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """record: the whole WARC record of each row of pages (page_id, url, html) but for the two line ends after it; and room,
    a number of bytes that it doesn't exceed, known without its digests."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), room(date).alias("room"))
    p = p.withColumns({"size": F.octet_length("payload"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)})
    same = ["sha256", "size"]
    held = p.filter(F.col("size") >= least).groupBy(*same).agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1 and holder is not null").drop("n")
    p = p.join(small(materialize(held, "holders"), BROADCAST_ROWS), same, "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    line = lambda name, *value: F.coalesce(F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n")), F.lit(""))
    ident = lambda c: F.concat(F.lit("<urn:sluiceway:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", ident("page_id")),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")),
        line("WARC-Payload-Digest-SHA256", F.lit("sha256:"), F.col("sha256")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", ident("holder")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
    )
    return p.select(F.concat(head, http, body).alias("record"), "room")


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, files: tuple[tuple[int, int], ...] = FILES) -> None:
    """Write gzip-compressed WARC files to a folder: the text writer with two line ends after each record.  Records are
    written by size, each size in one pass over those that there are; only these are hashed in it."""
    bound = pages.agg(F.max(room(DATE))).first()[0] or 0
    out, low = records(pages, least), -1
    for most, count in files:
        last = bound <= most or most == files[-1][0]
        some = out.filter(F.col("room") > low) if low >= 0 else out
        (some if last else some.filter(F.col("room") <= most)).select("record").write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", count).text(path)
        if last:
            return
        low = most


def parse(data: bytes) -> Iterator[tuple]:
    """The records of a file, as RECORD has them.  The payload of a response is compared with both digests."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        begin, size = end + 4, int(fields["Content-Length"])
        block = data[begin : begin + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, ids = fields["WARC-Type"], [fields[k][1:-1].rsplit(":", 1)[1] if k in fields else "none" for k in ("WARC-Record-ID", "WARC-Refers-To")]
        sha1, sha256 = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Payload-Digest-SHA256"].removeprefix("sha256:")
        if kind == "response" and (hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).hexdigest()) != (sha1, sha256):
            raise ValueError(f"a payload differs from its digest: {fields['WARC-Record-ID']}")
        page, refers = (None if x == "none" else int(x) for x in ids)
        yield page, fields.get("WARC-Target-URI"), kind, refers, head, http.decode("utf-8"), sha1, sha256, payload.decode("utf-8") if kind == "response" else None
        at = begin + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files in a folder, as written (RECORD); a revisit's payload is null."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in RECORD.split(", ")]

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for r in parse(gzip.decompress(data.as_py())):
                    rows.append(r)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(tidy(parsed), RECORD)


def store(archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of an archive (a written table of RECORD): headers of all records, without payloads; and sha256,
    payload, each payload once.  Only the digests of payloads that came more than once are looked at together."""
    headers = materialize(archive.drop("payload").withColumn("record", F.monotonically_increasing_id()), "headers")
    whole = archive.filter("record_type = 'response'").select("sha256", "payload", F.coalesce("page_id", F.lit(-(2**63))).alias("id"))
    twice = headers.filter("record_type = 'response'").groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha256")
    twice = materialize(twice, "repeated-payloads")
    if twice.isEmpty():
        return headers, materialize(whole.select("sha256", "payload"), "payloads", "zstd")
    repeated = small(twice, BROADCAST_ROWS)
    one = whole.join(repeated, "sha256", "left_semi").groupBy("sha256").agg(F.max_by("payload", "id").alias("payload"))
    return headers, materialize(whole.join(repeated, "sha256", "left_anti").select("sha256", "payload").unionByName(one), "payloads", "zstd")


def restore(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """All records with their payloads, each joined by its digest; a revisit gets that of the record it refers to."""
    hot = materialize(headers.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_PAYLOAD).select("sha256", F.ceil(F.col("n") / HOT_PAYLOAD).cast("int").alias("salts")), "hot-payloads")
    if hot.isEmpty():
        return headers.drop("record").join(payloads, "sha256")
    hot, salts = small(hot, BROADCAST_ROWS), F.coalesce("salts", F.lit(1))
    dealt = headers.join(hot, "sha256", "left").withColumn("salt", F.pmod(F.xxhash64("record"), salts).cast("int")).drop("salts", "record")
    copies = payloads.join(hot, "sha256", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copies, ["sha256", "salt"]).drop("salt")


def record_text() -> Column:
    """The record of a restored row as it was written, but for the two line ends after it."""
    end = F.lit("\r\n\r\n")
    return F.concat("warc_header", end, "http_header", end, F.when(F.col("record_type") == "revisit", "").otherwise(F.col("payload")))


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write pages to WARC files in the shared folder, read them back and restore all records.

    Null html is an empty payload, a null url has no header line.  Equal payloads of at least `least` bytes are held by the
    largest page_id; rows that repeat that page_id all hold it, and so do rows whose page_ids are all null.  Each payload is
    in the store once, whether its records are revisits or not."""
    spark = pages.sparkSession
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    archive = materialize(read(spark, path), "archive", "zstd")
    headers, payloads = store(archive)
    release(archive)
    return restore(headers, payloads)
