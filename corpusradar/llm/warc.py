"""WARC archives: a writer that stores repeated payloads once, and a reader that salvages what damage leaves.

Writing is a plain text sink: a record is one string and CR LF CR LF the line separator, so Spark's committer makes retried
tasks safe. Reading lists the archives with Spark and walks each in one task, through a file handle with positioned reads, so
memory is bounded by the longest record and not by the archive. A record passes if its version line, header lines, length,
closing blank lines and, where it carries its payload, the payload digest all hold. After a failed check the reader searches
for the next version line (or gzip member, for archives compressed record by record) whose record passes, goes on from there,
and logs the bytes between as a gap with the reason.

Null payloads count as empty. Identifiers that are null are written as ``none`` and read back as null. Rows that repeat the
smallest identifier of equal payloads are all responses. Line breaks in addresses are percent-encoded. An empty table gives
no archive and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusradar.llm.common import stored
from corpusradar.session import fresh_folder

BREAK = "\r\n"
RECORD_SCHEMA = ("kind string, archive string, start long, end long, reason string, record_id string, record_type string, "
                 "uri string, refers_to string, payload_bytes long, payload_digest string, payload binary")
_WINDOW = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each five hex digits are four base-32 digits in another alphabet."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(df: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int = 0,
            date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``value``: one WARC record per row. Payloads of at least ``min_bytes`` that occur again become revisits."""
    pages = df.select(F.col(id_col).alias("id"), F.regexp_replace(F.regexp_replace(F.coalesce(uri_col, F.lit("")), "\r", "%0D"), "\n", "%0A").alias("uri"),
                      F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    pages = pages.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("long"),
                               "check": F.xxhash64("payload")})
    key = ["digest", "size", "check"]
    first = (pages.where(F.col("size") >= min_bytes).groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
             .where("copies > 1").drop("copies"))
    first = stored(first, "repeats")  # with its size known, Spark need not shuffle payloads for a small table
    repeats = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"),
                    F.lit("\r\n\r\n"))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit(BREAK))
    body = F.when(repeats, http).otherwise(F.concat(http, "payload"))
    value = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(repeats, "revisit").otherwise("response")), line("WARC-Record-ID", name("id")),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(repeats, F.concat(line("WARC-Refers-To", name("first_id")), line(
            "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit(BREAK), body)
    return pages.join(first, key, "left").select(value.alias("value"))


def write_archives(df: DataFrame, path: str, records_per_archive: int = 5000) -> None:
    """Records from ``records`` as ``.warc`` text files under ``path``."""
    df.write.option("lineSep", BREAK * 2).option("maxRecordsPerFile", records_per_archive).text(path)


class Damaged(Exception):
    """A check that failed, and why."""


class Archive:
    """Positioned reads over one archive; knows plain records and gzip members."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size

    def read(self, at: int, n: int) -> bytes:
        return self.handle.read_at(min(n, self.size - at), at) if at < self.size else b""

    def record_at(self, at: int) -> tuple[dict, int]:
        """The record that starts here and where it ends; ``Damaged`` if any check fails."""
        if self.read(at, 3) == b"\x1f\x8b\x08":
            member, end = self._member(at)
            record, used = parse(lambda i, n: member[i:i + n], 0, len(member))
            if used != len(member):
                raise Damaged("bytes after the record in its gzip member")
            return record, end
        return parse(self.read, at, self.size)

    def _member(self, at: int) -> tuple[bytes, int]:
        inflate, parts, end = zlib.decompressobj(wbits=31), [], at
        try:
            while not inflate.eof:
                piece = self.read(end, _WINDOW)
                if not piece:
                    raise Damaged("gzip member cut short")
                parts.append(inflate.decompress(piece))
                end += len(piece)
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from e
        return b"".join(parts), end - len(inflate.unused_data)

    def next_start(self, at: int) -> int:
        """The next place from ``at`` that looks like a version line or a gzip member; the archive's size if none."""
        while at < self.size:
            window = self.read(at, _WINDOW)
            if found := re.search(rb"WARC/1\.|\x1f\x8b\x08", window):
                return at + found.start()
            if at + len(window) >= self.size:
                return self.size
            at += len(window) - 6
        return self.size

    def walk(self) -> Iterator[tuple[str, int, int, dict | str]]:
        """``("record", start, end, record)`` and ``("gap", start, end, reason)`` from front to back, without holes."""
        at = 0
        while at < self.size:
            try:
                record, end = self.record_at(at)
                yield "record", at, end, record
                at = end
                continue
            except Damaged as e:
                reason = str(e)
            start, at = at, self.next_start(at + 1)
            found = None
            while at < self.size and found is None:
                try:
                    found = self.record_at(at)
                except Damaged:
                    at = self.next_start(at + 1)
            yield "gap", start, at, reason
            if found:
                yield "record", at, found[1], found[0]
                at = found[1]


def _check_lines(lines: list[bytes]) -> None:
    if lines and not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Damaged("no version line")
    if any(b":" not in text for text in lines[1:]):
        raise Damaged("a header line without a colon")


def parse(read, at: int, size: int) -> tuple[dict, int]:
    """Check and take apart the record at ``at``; its fields and its end.

    A header may have any length; lines that have been read whole are checked before more is read, so a false start costs little.
    """
    head, want = b"", 4096
    while (stop := head.find(b"\r\n\r\n")) < 0:
        _check_lines(head[:head.rfind(b"\r\n") + 2].split(b"\r\n")[:-1])
        if len(head) >= size - at:
            raise Damaged("no end of the header")
        head, want = read(at, want), want * 4
    lines = head[:stop].split(b"\r\n")
    _check_lines(lines)
    fields = {}
    for text in lines[1:]:
        label, _, value = text.partition(b":")
        fields[label.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damaged("a needed header line is missing")
    start = at + stop + 4
    end = start + int(fields["content-length"])
    if end + 4 > size or read(end, 4) != b"\r\n\r\n":
        raise Damaged("the length does not lead to the end of a record")
    body = read(start, end - start)
    http, blank, payload = body.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: *(\d+)", http)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    whole = fields["warc-type"] != "revisit"
    if whole and stated and base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated:
        raise Damaged("the payload does not have its digest")
    return {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"), "payload_digest": stated or None, "payload": payload if whole else None,
            "payload_bytes": len(payload) if whole else int(length[1]) if length else None}, end + 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of ``RECORD_SCHEMA`` of all archives under ``path``: ``kind`` is ``record`` or ``gap``."""
    names = [field.split()[0] for field in RECORD_SCHEMA.split(", ")]
    types = {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(name, types.get(name, pa.string())) for name in names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                files, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
                rows, held = [], 0
                with files.open_input_file(inner) as handle:
                    for kind, start, end, what in Archive(handle, size).walk():
                        fields = dict(what) if kind == "record" else {"reason": what}
                        if not with_payload:
                            fields["payload"] = None
                        rows.append({**dict.fromkeys(names), "kind": kind, "archive": uri, "start": start, "end": end, **fields})
                        held += len(fields.get("payload") or b"")
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where("length > 0").mapInArrow(walk, RECORD_SCHEMA)


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = fresh_folder(spark, "warc")
    write_archives(records(pages, "page_id", "url", "html"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    found = read_archives(spark, path, with_payload=False)  # a gap in archives just written is an error, not a page less
    gap = F.raise_error(F.concat_ws(" ", F.lit("a gap in an archive just written:"), "archive", "start", "reason")).cast("string")
    return found.withColumn("record_id", F.when(F.col("kind") == "record", F.col("record_id")).otherwise(gap)).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT x, min(page_id) AS first_id FROM p GROUP BY x),
digits AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             CAST((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1), '' ORDER BY i) AS d
           FROM p, range(32) AS r(i) GROUP BY page_id)
SELECT p.page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN p.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN g ON p.x = g.x JOIN digits USING (page_id)
"""
