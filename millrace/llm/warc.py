"""Operator 10, WARC with revisit resolution.

Headers (page id, address, length, SHA-1 digest) are shuffled by payload digest, with a partial maximum before the
shuffle, and joined back to find each digest's original; the bodies never take part in that. Records are then written
through Spark's own text writer, so archives land on whatever store the shared folder is on and a lost task is run again
under the commit protocol; every record ends with the blank lines that WARC asks for, which is the writer's line end.
An archive is compressed as a whole, one gzip member a file. Pages are written in bands of like length, so that the
records of a file are bounded by ``FILE_BYTES`` as well as by their number and one task can read it (a longer page is a
file of its own). Reading goes by Content-Length, so a payload may hold anything, record starts and blank lines included.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import narrow, saved, shared_dir

#: Payloads under this many bytes are never stored as a revisit.
LEAST_BYTES = 1000
#: Records of an archive file, and bytes of their payloads, at most.
RECORDS_PER_FILE, FILE_BYTES = 1000, 256 << 20
#: Bytes of a record beside its payload that a file is planned with.
_HEAD_BYTES = 1024
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolved(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, bytes, digest, kind and refers_to of every row; one of equal payloads is the original.

    Of rows with equal payloads of at least ``least`` bytes that with the largest page_id is the response (a null id is
    smaller than any). Rows that repeat that id with that payload are responses too.
    """
    rows = narrow(pages, page_id="page_id", url="url", html="html")
    rows = rows.withColumn("html", F.coalesce("html", F.lit(""))).withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "utf-8"))})
    heads = rows.where(F.col("bytes") >= least).select("page_id", "digest")
    # saved, so that each side of the join is dealt by itself and a hot digest can be split
    originals = saved(heads.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"), "originals")
    revisits = heads.join(originals, "digest").where("original is not null and not (page_id <=> original)").select("page_id", "digest", "original").distinct()
    # by page_id and digest: the bodies are spread evenly whatever their payloads; null ids are few and join by null-safe equality
    marked = rows.alias("r").join(revisits.alias("v"), F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.digest") == F.col("v.digest")), "left")
    return marked.select("r.page_id", "r.url", "r.html", "r.bytes", "r.digest", F.when(F.col("v.digest").isNull(), "response").otherwise("revisit").alias("kind"), F.col("v.original").alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha1(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def records(rows: DataFrame, when: datetime | None = None) -> DataFrame:
    """A text ``value`` per row of ``resolved``: a whole WARC/1.1 record without its closing blank lines.

    Headers are fresh: record ids, lengths and digests come from what is stored, the date is that of writing (``when``, or
    now). Line ends in an address are percent-encoded.
    """
    date = (when or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    page, digest = F.col("page_id"), F.col("digest")
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("kind") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("kind"), F.lit("\r\n"),
        _line("WARC-Record-ID", _record_id(page, digest)), F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", address), _line("X-Page-ID", page.cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), _line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\n"), _line("WARC-Refers-To", _record_id(F.col("refers_to"), digest)), _line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def _bands(rows: DataFrame, per_file: int, file_bytes: int) -> list[tuple[int, int, int]]:
    """Lengths of payloads, from and up to, and the records of a file of such: bands that have rows, the shortest pages' first."""
    short = max(1, file_bytes // per_file - _HEAD_BYTES)  # of these a file holds as many as it may
    grade = F.when(F.col("bytes") < short, 0).otherwise(F.floor(F.log2(F.col("bytes") / F.lit(short))) + 1).cast("int")
    grades = sorted(r.g for r in rows.select(grade.alias("g")).distinct().collect())
    bounds = [(short << (g - 1) if g else 0, short << g) for g in grades]
    return [(low, high, max(1, min(per_file, file_bytes // (high + _HEAD_BYTES)))) for low, high in bounds]


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES, when: datetime | None = None) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) as deduplicated archives in folders under ``path``, one for each band of lengths.

    A null html is an empty payload, a null address or page id leaves its header out, repeated rows are repeated records,
    an empty table gives archives without records. Other columns aren't read.
    """
    when = when or datetime.now(UTC)
    lengths = narrow(pages, html="html").select(F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"))
    rows = resolved(pages, least)
    bands = _bands(lengths, per_file, file_bytes) or [(0, 1, per_file)]
    for low, high, most in bands:
        own = rows if len(bands) == 1 else rows.where((F.col("bytes") >= low) & (F.col("bytes") < high))
        records(own, when).write.option("lineSep", _END).option("maxRecordsPerFile", most).option("compression", "gzip").text(f"{path}/to{high}")


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (by lower-case name) and the block of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record starts at byte {at}")
        stop = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8").partition(": ")
            head[name.lower()] = value
        body = stop + 4
        size = int(head["content-length"])
        if data[body + size : body + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end after {size} bytes")
        yield head, data[body : body + size]
        at = body + size + 4


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record under ``path``; a stored payload is checked against its digest and length, and sent on if ``payloads``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: dict[str, list] = {c.split()[0]: [] for c in _READ.split(", ")}
                for head, body in parsed(gzip.decompress(content.as_py())):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(head["x-payload-length"])):
                        raise ValueError(f"payload of {head['warc-record-id']} is damaged")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    for k, v in zip(rows, (number("x-page-id"), head.get("warc-target-uri"), int(head["x-payload-length"]), digest, head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), number("x-refers-to-page-id"), body if payloads else None)):
                        rows[k].append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/millrace/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER same AND max(page_id) OVER same IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER same
            THEN max(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
"""
