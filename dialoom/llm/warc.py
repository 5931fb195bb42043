"""Web archives: a writer on Spark's text sink and a reader that salvages what damage leaves.

`write` turns each page into one WARC/1.1 record. Of records with equal payloads of at least `min_bytes` bytes
the one with the smallest id keeps its payload, the others become `revisit` records that point to it.
`salvage` walks an archive: a record whose version line, headers, length or digest don't hold is given up, the
reader searches for the next gzip member or version line, goes on there, and logs the byte range it skipped.

Defined results: a null payload is empty; rows that share an id keep a record each, which revisits tell apart by the
digest; an id of null gives a record without a
page id; damaged ranges come back as gaps, never as an error; an empty table gives an archive without records;
only the named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import scratch, stored, table, text_of

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH, NUMBER = re.compile(r"[0-9]{1,18}"), re.compile(r"-?[0-9]{1,18}")
GZIP = b"\x1f\x8b\x08"
SCHEMA = "archive string, at long, upto long, kind string, page_id long, uri string, digest string, n_bytes long, refers_to long, refers_uri string, reason string, payload binary"


def _members(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(from, read to, to, plain bytes) of each gzip member; a damaged one ends where the next readable one starts, and
    is read up to its damage."""
    at = 0
    while at < len(data):
        d, plain, ok, upto = zlib.decompressobj(31), [], False, at
        if data[at : at + 3] == GZIP:
            view, step = at, 1 << 12
            while not d.eof and view < len(data):
                before = d.copy()
                try:
                    plain.append(d.decompress(data[view : view + step]))
                except zlib.error:  # byte by byte: all that precedes the damage
                    try:
                        for i in range(view, min(view + step, len(data))):
                            plain.append(before.decompress(data[i : i + 1]))
                            upto = i + 1
                    except zlib.error:
                        pass
                    break
                view, step = view + step, min(2 * step, 1 << 16)
                upto = min(view, len(data))
            ok = d.eof
            end = upto - len(d.unused_data)
        if not ok:
            end = data.find(GZIP, at + 1)
            while end >= 0 and not _opens(data, end):
                end = data.find(GZIP, end + 1)
            end = len(data) if end < 0 else end
        yield at, end if ok else min(upto, end), end, b"".join(plain)
        at = end


def _opens(data: bytes, at: int) -> bytes:
    """The first bytes of the gzip member at `at`, empty where none opens."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 512]) or b"\n"
    except zlib.error:
        return b""


def _zipped(data: bytes) -> bool:
    """The archive is made of gzip members, though the first ones may be damaged: somewhere a member opens with a
    version line and isn't part of a readable plain record."""
    if data[:3] == GZIP or VERSION.match(data):
        return data[:3] == GZIP
    done, at, plain = 0, data.find(GZIP), VERSION.search(data)
    while at >= 0:
        if at >= done and VERSION.match(_opens(data, at)):
            while plain and plain.start() < at and done <= at:
                record, end, _ = _record(data, plain.start())
                done = end if record else done
                plain = VERSION.search(data, max(end, plain.start() + 1))
            if done <= at:
                return True
        at = data.find(GZIP, max(done, at + 1))
    return False


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at `at`: (record, its end, '') or (None, at, why not)."""
    if not VERSION.match(data, at):
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None, at, "headers don't end"
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "header line without a colon"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not LENGTH.fullmatch(fields.get("content-length", "")) or "warc-type" not in fields:
        return None, at, "no length or type"
    body, size = stop + 4, int(fields["content-length"])
    if body + size > len(data):
        return None, at, "shorter than its length"
    if data[body + size : body + size + 4] != b"\r\n\r\n":
        return None, at, "no end mark after its length"
    payload = data[body : body + size]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] != "revisit" and digest and hashlib.sha256(payload).hexdigest() != digest:
        return None, at, "digest differs"
    return {"fields": fields, "payload": payload, "digest": digest}, body + size + 4, ""


def salvage(data: bytes) -> Iterator[dict]:
    """Records (kind response, revisit, ...) and gaps (kind gap) of an archive, in order, with byte ranges.

    Ranges are those of the file. Of a gzip member, records and gaps in its plain text have the range that could be
    inflated, and what could not is a gap of its own, so gaps of damaged members don't overlap with records."""
    if not _zipped(data):
        yield from _plain(data)
        return
    for a, upto, b, plain in _members(data):
        yield from (r | {"at": a, "upto": upto} for r in _plain(plain))
        if not plain and upto < b:  # records that were stored as they are, and what lies between
            yield from (r | {"at": r["at"] + a, "upto": r["upto"] + a} for r in _plain(data[a:b], "damaged gzip member"))
        elif upto < b:
            yield {"kind": "gap", "at": upto, "upto": b, "reason": "damaged gzip member"}


def _plain(data: bytes, otherwise: str | None = None) -> Iterator[dict]:
    """Records and gaps of plain bytes; otherwise: the reason to give for gaps."""
    at = 0
    while at < len(data):
        record, end, why = _record(data, at)
        if record is None:
            nxt = VERSION.search(data, at + 1)
            end = nxt.start() if nxt else len(data)
            yield {"kind": "gap", "at": at, "upto": end, "reason": otherwise or why}
        else:
            f = record["fields"]
            number = lambda x: int(x) if NUMBER.fullmatch(x or "") else None
            yield {
                "kind": f["warc-type"], "at": at, "upto": end, "page_id": number(f.get("warc-record-id", "").strip("<>").removeprefix("urn:page:")), "uri": f.get("warc-target-uri"), "digest": record["digest"] or None,
                "n_bytes": len(record["payload"]), "refers_to": number(f.get("warc-refers-to", "").strip("<>").removeprefix("urn:page:")), "refers_uri": f.get("warc-refers-to-target-uri"), "payload": record["payload"], "reason": None,
            }
        at = end


def plan_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = 100) -> DataFrame:
    """(page_id, uri, html, digest, n, refers_to): what each record will be. Payloads don't move: only ids and
    digests of payloads that occur more than once are shuffled before the join that decides."""
    raw = pages.select(F.col(key).cast("long").alias("page_id"), F.col(uri).cast("string").alias("uri"), text_of(payload).alias("html"))
    raw = raw.select("*", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.octet_length("html").alias("n"))
    first = raw.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    return raw.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, which is 0: the top byte of the length, or that of an
    empty member put after records of 16 MB or more."""
    for b in batches:
        out = []
        for x in b.column(0):
            member = gzip.compress(x.as_py(), 6, mtime=0)
            out.append((member if member[-1] == 0 else member + gzip.compress(b"", mtime=0))[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write(records: DataFrame, path: str, records_per_file: int = 1000, file_bytes: int = 256 << 20) -> None:
    """One WARC record per row, each a gzip member of its own, so that damage costs one record. The text sink writes
    the bytes as they are to any file system that Spark writes to; its line end, a zero byte, is each member's last byte.
    A file holds so few records that even the longest payloads stay under file_bytes, as one task reads a file whole."""
    longest = records.agg(F.max("n")).first()[0] or 1
    records_per_file = max(1, min(records_per_file, file_bytes // longest))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]+", " ")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))), line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))), F.lit("\r\n"),
    )
    out = records.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")), F.lit("\r\n\r\n")).cast("binary").alias("value"))
    out.mapInArrow(_packed, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under a path; one file a row, salvaged in the task that reads it."""
    kind = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("upto", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("refers_to", pa.int64()), ("refers_uri", pa.string()), ("reason", pa.string()), ("payload", pa.binary())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for r in salvage(data.as_py()):
                    if r["kind"] not in ("gap", "revisit"):
                        r["digest"] = hashlib.sha256(r["payload"]).hexdigest()
                    rows.append({"archive": name} | r | ({} if payloads else {"payload": None}))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt*").load(path)
    return files.select("path", "content").mapInArrow(take, SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Revisits get the size of the response that they refer to, which has their id and digest; an unresolved one has a null
    size. The responses are stored, so that adaptive execution can split the rows that refer to one page."""
    whole = stored(records.where("kind = 'response'").groupBy(F.col("page_id").alias("to"), F.col("digest").alias("of_digest")).agg(F.first("n_bytes").alias("of_bytes")), "responses")
    both = records.where("kind in ('response', 'revisit')").join(whole, (F.col("refers_to") == F.col("to")) & (F.col("digest") == F.col("of_digest")), "left")
    again = F.col("kind") == "revisit"
    return both.select("page_id", F.when(again, F.col("of_bytes")).otherwise(F.col("n_bytes")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "uri", "archive")


def gaps(records: DataFrame) -> DataFrame:
    """(archive, at, upto, reason): the log of quarantined byte ranges."""
    return records.where("kind = 'gap'").select("archive", "at", "upto", "reason")


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back; the gap log is written beside the records."""
    path = scratch(spark, "warc")
    write(plan_records(table(spark, sf_dir, "pages")), path)
    records = stored(read(spark, path, payloads=False).drop("payload"), "records")
    stored(gaps(records), "gaps")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


#: The query in DuckDB's SQL.
ORACLE = """SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN CAST(first AS BIGINT) END AS refers_to, regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g') AS uri
FROM (SELECT *, strlen(body) >= 100 AND page_id <> first AS again FROM (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM (SELECT page_id, url, coalesce(html, '') AS body FROM pages)))"""
