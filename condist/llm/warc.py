"""Web archives as chunked record tables.

A record's HTTP block uses chunked transfer coding, so that each chunk row is a
complete piece of the archive file: Spark's text writer, with CRLF as its line
separator and gzip as its codec, streams header rows and chunk rows to one
standard ``.warc.gz``-style stream per task. Reading is the reverse: a task
goes through its files line by line and hands out (record_id, chunk_no) rows
with the digest and size of the payload so far. At no point does a reader hold
a record, only one chunk of it.

Defined cases: a null html is an empty payload, which is a response record with
one final chunk row of no bytes; a null url leaves its header out; a null
page_id never counts as the largest, and its row revisits another row's
payload if one with an id exists; repeated rows share a record id and are all
written; an empty table reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condist.llm.scratch import shared_path

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
CHUNKED = f"{HTTP}Transfer-Encoding: chunked{CRLF}{CRLF}"
BARE = f"{HTTP}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CHUNKS = (
    "record_id string, chunk_no int, page_id long, url string, record_type string, refers_to long, "
    "data binary, bytes_so_far long, digest_so_far string, final boolean"
)

KINDS = {
    "record_id": pa.string(),
    "chunk_no": pa.int32(),
    "page_id": pa.int64(),
    "url": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "data": pa.binary(),
    "bytes_so_far": pa.int64(),
    "digest_so_far": pa.string(),
    "final": pa.bool_(),
}


def records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Pages with payload, digest and record type.

    Of equal payloads of at least ``min_bytes``, the row with the largest
    page_id keeps the payload. Smaller ones, of which very many can be equal,
    take no part in the join by digest.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    kept = (
        rows.where(F.col("size") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "kept")
    )
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    large = rows.where(F.col("size") >= min_bytes).join(kept, "digest", "left")
    small = rows.where(F.col("size") < min_bytes).withColumn("kept", F.lit(None).cast("long"))
    return large.unionByName(small).select(
        "page_id",
        "url",
        "digest",
        "size",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def lines(rows: DataFrame, chunk_bytes: int, date: str) -> DataFrame:
    """What goes to the archive, in order within a record: a header row, chunk rows, an end row.

    Each is bytes without the CRLF that the writer puts after it.
    """
    c = F.col
    full, part = F.floor(c("size") / chunk_bytes), c("size") % chunk_bytes
    response = c("record_type") == "response"
    framing = full * (chunk_bytes + len(f"{chunk_bytes:X}") + 4) + F.when(part > 0, part + F.length(F.hex(part)) + 4).otherwise(0)
    block = F.when(response, framing + len(CHUNKED) + 5).otherwise(len(BARE)).cast("long")
    name = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), c("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name(c("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), c("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), c("size").cast("string")),
        F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), name(c("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
        F.lit(""),
        F.when(response, F.lit(CHUNKED[: -len(CRLF)])).otherwise(F.lit(BARE + CRLF)),
    )
    chunks = F.when(response, F.ceil(c("size") / chunk_bytes)).otherwise(-1)
    steps = rows.withColumn("head", head).withColumn("k", F.explode(F.sequence(F.lit(0), (chunks + 1).cast("int"))))
    n = F.least(F.lit(chunk_bytes).cast("long"), c("size") - (c("k") - 1) * chunk_bytes)
    piece = F.concat(F.concat(F.hex(n), F.lit(CRLF)).cast("binary"), F.substring("payload", (c("k") - 1) * chunk_bytes + 1, F.lit(chunk_bytes)))
    return steps.select(
        F.when(c("k") == 0, c("head").cast("binary"))
        .when(n > 0, piece)
        .otherwise(F.lit(f"0{CRLF}{CRLF}{CRLF}").cast("binary"))
        .alias("line")
    )


def write(pages: DataFrame, path: str, chunk_bytes: int = 1 << 16, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the pages as gzip-compressed WARC files under ``path``, one for each task."""
    out = lines(records(pages, min_bytes), chunk_bytes, date)
    # a cast from bytes to string keeps the bytes as they are, and so does the text writer
    out.select(F.col("line").cast("string").alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


class Parser:
    """Takes an archive's lines; ``done`` gets chunk rows. Holds one chunk at most."""

    def __init__(self, with_data: bool):
        self.with_data, self.done, self.state = with_data, [], "record"

    def row(self, data: bytes | None, final: bool) -> None:
        h = self.head
        revisit = h["WARC-Type"] == "revisit"
        self.done.append(
            (
                h["WARC-Record-ID"],
                self.chunk_no,
                _page(h["WARC-Record-ID"]),
                h.get("WARC-Target-URI"),
                h["WARC-Type"],
                _page(h.get("WARC-Refers-To")),
                data if self.with_data else None,
                int(h["WARC-Payload-Length"]) if revisit else self.size,
                h["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else self.sha.hexdigest(),
                final,
            )
        )
        self.chunk_no += 1

    def line(self, line: bytes) -> None:
        if self.state == "data":
            self.buffer += line
            if len(self.buffer) == self.wanted:
                self.ready()
                self.state = "size"
            elif len(self.buffer) + 2 > self.wanted:
                raise ValueError(f"chunk of {self.head['WARC-Record-ID']} does not have its size")
            else:
                self.buffer += b"\r\n"  # the payload's own
        elif self.state == "size":
            self.wanted = int(line, 16)
            self.buffer = bytearray()
            self.state = "data" if self.wanted else "record"
            if not self.wanted:
                if self.size != int(self.head["WARC-Payload-Length"]) or self.sha.hexdigest() != self.head["WARC-Payload-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"payload of {self.head['WARC-Record-ID']} does not match its digest")
                self.row(b"", True)
        elif self.state == "head":
            if line:
                key, _, value = line.decode().partition(": ")
                self.head[key] = value
            else:
                self.state = "http"
        elif self.state == "http":
            if not line:
                self.sha, self.size, self.chunk_no = hashlib.sha1(), 0, 0
                self.state = "size"
                if self.head["WARC-Type"] == "revisit":
                    self.row(None, True)
                    self.state = "record"
        elif line:
            if line != b"WARC/1.0":
                raise ValueError("not at the start of a record")
            self.head, self.state = {}, "head"

    def ready(self) -> None:
        self.sha.update(self.buffer)
        self.size += len(self.buffer)
        self.row(bytes(self.buffer), False)


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def read(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """Chunk rows of all records under ``path``. The last row of a record is ``final`` and has its whole digest and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(with_data)

        def out() -> pa.RecordBatch:
            columns = zip(*parser.done, strict=True) if parser.done else [[] for _ in KINDS]
            batch = pa.record_batch([pa.array(list(x), k) for x, k in zip(columns, KINDS.values(), strict=True)], list(KINDS))
            parser.done = []
            return batch

        for batch in batches:
            held = 0
            for value in batch.column(0).to_pylist():
                parser.line(value)
                held += len(value)
                if held > 8 << 20 and parser.done:
                    yield out()
                    held = 0
            yield out()
        if parser.state != "record":
            raise ValueError("the archive ends within a record")

    text = spark.read.option("lineSep", CRLF).text(path)
    return text.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, CHUNKS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, and give each page's record."""
    path = shared_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return page_records(read(spark, path, with_data=False))


def page_records(chunks: DataFrame) -> DataFrame:
    return chunks.where("final").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b)) AS k FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> k THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> k THEN k END AS refers_to
FROM d"""
