"""WARC archives with revisit resolution.

Payload digests are computed where the pages are read, and only headers (id, digest) are shuffled:
the smallest id per digest is found with a partial aggregate and joined back, with a salt, so a
payload that a third of all pages share is spread over many tasks.  Archives are written as text by
Spark's own writer, compressed, with the record end after each record: payloads are UTF-8 text, so a
record is one too.  A revisit record has fresh headers that name the original and no payload.

Reading goes by Content-Length, so a payload may hold anything, record heads and blank lines
included.  Files are bounded by the number of records, and a file is one task.

Defined results: a null html is an empty payload; a null url has no target header and comes back
null; equal rows that share the smallest id are all responses; a page without id is a response by
itself that nothing refers to; pages without rows give an empty archive; other columns are not kept.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.shared import stage_path

#: Fixed values of the format.
BREAK, RECORD_END, VERSION = "\r\n", "\r\n\r\n", "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_RECORDS = 4000
SALTS = 32
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string, offset long"


def base32(sha1_hex: Column) -> Column:
    """Bare upper-case base32 of 160 bits in hex."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * k, 10), 16, 2), 40, "0") for k in range(4)])
    digit = lambda b, k: F.substring(F.lit(BASE32), F.conv(F.substr(b, k * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    of = lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: digit(b, k)), "")
    return F.get(F.transform(F.array(bits), of), F.lit(0))


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload another page has under a smaller id."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    heads = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    heads = heads.filter(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes)).drop("size")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = heads.withColumn("salt", F.pmod("page_id", F.lit(SALTS)).cast("int"))
    met = salted.join(first.hint("merge"), ["digest", "salt"]).filter(F.col("page_id") > F.col("first"))
    return met.select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def _record_id(page_id: Column) -> Column:
    """A stable URN from the page id; null for a null id."""
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """One WARC record per page, as text."""
    revisits = resolve(pages, least_bytes)
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    page = page.join(revisits, ["page_id", "digest"], "left")
    header = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(BREAK))  # noqa: E731  null without a value
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    again = F.col("refers_to").isNotNull()
    body = F.when(again, "").otherwise(F.col("html"))
    head = F.concat_ws(
        "",
        F.lit(VERSION + BREAK),
        F.when(again, f"WARC-Type: revisit{BREAK}").otherwise(f"WARC-Type: response{BREAK}"),
        header("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))),
        header("WARC-Target-URI", escaped),
        F.lit(f"WARC-Date: {date}{BREAK}"),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        header("X-Page-ID", F.col("page_id").cast("string")),
        F.when(again, F.concat_ws("", F.lit(f"WARC-Profile: {PROFILE}{BREAK}"), header("WARC-Refers-To", _record_id(F.col("refers_to"))), header("X-Refers-To-Page", F.col("refers_to").cast("string")))),
        header("X-Payload-Bytes", F.octet_length("html").cast("string")),
        F.lit(f"Content-Type: text/html; charset=utf-8{BREAK}"),
        header("Content-Length", F.octet_length(body).cast("string")),
    )
    return page.select(F.concat(head, F.lit(BREAK), body).alias("value"))


def write(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write archives into a folder that all executors share; returns the folder."""
    path = path or stage_path(pages.sparkSession, f"warc-{uuid.uuid4().hex[:6]}")
    writer = records(pages, **options).write.mode("overwrite").option("lineSep", RECORD_END)
    writer.option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)
    return path


def parse(archive: bytes) -> Iterator[dict]:
    """The records of one archive, each with its offset."""
    end, mark = len(archive), RECORD_END.encode()
    at = 0
    while at < end:
        stop = archive.index(mark, at)
        lines = archive[at:stop].decode().split(BREAK)
        if lines[0] != VERSION:
            raise ValueError(f"no record begins at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = stop + len(mark)
        after = start + int(head["Content-Length"])
        yield {"offset": at, "head": head, "payload": archive[start:after]}
        if archive[after : after + len(mark)] != mark:
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        at = after + len(mark)


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = lambda x: None if x is None else int(x)
    for frame in frames:
        for archive in frame["content"]:
            rows = []
            for record in parse(gzip.decompress(archive)):
                head, payload = record["head"], record["payload"]
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                response = head["WARC-Type"] == "response"
                if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload of the record at byte {record['offset']} doesn't match its digest")
                url = head.get("WARC-Target-URI")
                url = None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                rows.append((
                    number(head.get("X-Page-ID")), url, head["WARC-Type"], number(head.get("X-Refers-To-Page")), digest,
                    len(payload) if response else int(head["X-Payload-Bytes"]), payload.decode() if response else None, record["offset"],
                ))
                if len(rows) == 1000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.strip().split(" ")[0] for x in READ.split(",")]
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder; a revisit's payload is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInPandas(_rows, READ)
