"""Web archives with repeated payloads resolved to revisit records.

Headers alone are shuffled by payload digest to find which payloads repeat and who keeps them; a
record whose payload another record keeps is written as a revisit of it, without the payload.
Where so many payloads repeat that their list can't be broadcast, rows are shuffled to it. Archives are WARC/1.1 text written by Spark's
own text writer, so any storage that Spark reaches will do: a record is one value, the blank
line behind its block is half in the value and half the line separator. All of writing runs in
the JVM. Reading streams through the archives' lines and ends records by their Content-Length,
so a payload may hold anything, record heads included, and an archive may have any size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import table
from gradus.session import scratch_path, write_out

#: Records in one archive file, at most, and its bytes of payload, about.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 50_000, 1 << 30
#: What stands before a response's payload in its block, with the payload's size.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Payloads with at least so many bytes are resolved; smaller ones are all responses.
LEAST_BYTES = 0
_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of ``payload`` in base 32: five hex digits make four base-32 ones."""
    digits = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)
    ]
    return F.translate(F.concat(*parts), _HEX, _BASE32)


def resolve(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``digest, bytes, keeper, keeper_url`` of payloads that two records or more have.

    Counts and maxima are summed before the shuffle: a payload of a third of all records is one
    row of each task. The keeper is the largest identifier, NULL being smaller than any.
    """
    return (
        heads.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select(
            "payload_digest",
            "payload_bytes",
            F.col("keeper.page_id").alias("keeper"),
            F.col("keeper.url").alias("keeper_url"),
        )
    )


def _line(name: str, value: Column) -> Column:
    # A header is one line whatever the value holds.
    clean = F.regexp_replace(value, r"[\r\n]+", " ")
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")))


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = LEAST_BYTES,
    records_per_archive: int = ARCHIVE_RECORDS,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    date: str | None = None,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write one record per row of ``pages`` to gzip-compressed archives in the folder ``path``.

    A response's block is an HTTP response with the payload; every record has an identifier of its
    own and the date of writing (``date``: another one, such as 2024-05-01T00:00:00Z). An archive has
    at most ``records_per_archive`` records, and so few that about ``archive_bytes`` of payload of
    mean size fill it. A NULL payload is empty; a NULL url gives a record without target; a NULL identifier gives a
    record without page number. Of equal payloads the record with the largest identifier is the
    response; where several rows repeat that identifier, all of them are. Other columns are
    ignored. An empty table writes archives without records.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("payload"),
    ).withColumns(
        {
            "payload_digest": base32_sha1(F.col("payload").cast("binary")),
            "payload_bytes": F.octet_length("payload").cast("long"),
        }
    )
    sizes = Observation("warc")
    seen = rows.observe(sizes, F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes"))
    keepers = write_out(resolve(seen, least_bytes), "warc-keepers")
    mean = max(1.0, (sizes.get["bytes"] or 0) / max(1, sizes.get["n"]))
    records_per_archive = max(1, min(records_per_archive, int(archive_bytes / mean)))
    written = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = F.format_string(HTTP_HEAD, F.col("payload_bytes"))
    block_bytes = F.col("payload_bytes") + F.octet_length(head)
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        _line("WARC-Date", F.lit(written)),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("keeper_url"))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.lit(written))),
        _line("WARC-Refers-To-Page-ID", F.when(revisit, F.col("keeper").cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.when(revisit, "0").otherwise(block_bytes.cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.concat(head, F.col("payload"))),
        F.lit("\r\n"),
    )
    # A large list of keepers makes this a shuffle join whose hot digests are split at run time;
    # a small one (Spark goes by its measured size) leaves the payloads where they are.
    joined = rows.join(keepers, ["payload_digest", "payload_bytes"], "left")
    (
        joined.select(record.alias("value"))
        .write.option("lineSep", "\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_archive)
        .text(path)
    )


class _Parser:
    """Puts records together from the CRLF-ended lines of archives, one line at a time."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.block: list[bytes] | None = None
        self.size = self.seen = 0
        self.ended = False

    def feed(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        """The record that ends with ``line``, if one does."""
        if self.head is None:
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            self.head = {}
        elif self.block is None:
            if line:
                name, _, value = line.decode("utf-8").partition(": ")
                self.head[name] = value
            else:
                self.block, self.seen = [], 0
                self.size = int(self.head["Content-Length"])
        elif self.ended:
            if line:
                raise ValueError("a record is longer than its Content-Length")
            record = self.head, b"\r\n".join(self.block)
            self.head, self.block, self.ended = None, None, False
            return record
        else:
            self.seen += len(line) + 2 * bool(self.block)
            self.block.append(line)
            self.ended = self.seen == self.size
            if self.seen > self.size:
                raise ValueError("a record is longer than its Content-Length")
        return None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record under ``path``: headers, and the payload's size and digest as read.

    The payload is what follows the HTTP head of a response's block. ``page_id, url, record_type, refers_to, stated_digest, payload_bytes, payload_digest,
    payload``; the last three are NULL for revisits, the last one also without ``payloads``.
    Compressed archives aren't split, so a task has the lines of whole archives in order; it
    holds one batch of lines and one record at a time.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _Parser()
        for batch in batches:
            out = []
            for line in batch["line"]:
                if (record := parser.feed(line)) is None:
                    continue
                head, block = record
                page, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                full = head["WARC-Type"] == "response"
                if full:
                    block = block.partition(b"\r\n\r\n")[2]
                out.append(
                    (
                        int(page) if page else None,
                        head.get("WARC-Target-URI"),
                        head["WARC-Type"],
                        int(refers) if refers else None,
                        head["WARC-Payload-Digest"].removeprefix("sha1:"),
                        len(block) if full else None,
                        base64.b32encode(hashlib.sha1(block).digest()).decode() if full else None,
                        block.decode("utf-8") if full and payloads else None,
                    )
                )
            frame = pd.DataFrame(out, columns=names)
            for name in ("page_id", "refers_to", "payload_bytes"):
                frame[name] = frame[name].astype("Int64")
            yield frame
        if parser.head is not None:
            raise ValueError("an archive ends within a record")

    schema = (
        "page_id long, url string, record_type string, refers_to long, stated_digest string, "
        "payload_bytes long, payload_digest string, payload string"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    lines = spark.read.option("lineSep", "\r\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("line")).mapInPandas(parse, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with every revisit's size and digest taken from the response that it refers to.

    The shuffle is of headers by payload digest; a response is found by digest and identifier.
    """
    heads = records.drop("payload")
    originals = (
        heads.where("record_type = 'response'")
        .select(
            F.col("payload_digest").alias("stated_digest"),
            F.col("page_id").alias("refers_to"),
            F.col("payload_bytes").alias("original_bytes"),
        )
        .distinct()
    )
    revisits = heads.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    found = revisits.join(originals, ["stated_digest", "refers_to"], "left")
    return heads.where("record_type = 'response'").unionByName(
        found.select(
            "page_id",
            "url",
            "record_type",
            "refers_to",
            "stated_digest",
            F.col("original_bytes").alias("payload_bytes"),
            F.when(F.col("original_bytes").isNotNull(), F.col("stated_digest")).alias("payload_digest"),
        )
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    heads = write_out(read_archives(spark, path, payloads=False).drop("payload"), "warc-heads")
    return resolve_revisits(heads).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
