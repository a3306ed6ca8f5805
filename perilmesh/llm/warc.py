"""WARC archives: a writer with revisits, and a reader that salvages damaged files.

Archives are written by Spark's text sink, so its commit protocol holds for lost
tasks on any store: a row is a gzip member without its last byte, and the line
separator is that byte.  A member ends with the length of its content in four
little-endian bytes, of which the last is zero below 16 MiB; longer records
are cut into several members.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, binary

_PART = 8 << 20
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]\.[0-9]\r\n")
_ID = "urn:page:"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(sha1(data).digest()).decode()


class Damaged(Exception):
    """What stands at a position isn't a whole record."""


# ---------------------------------------------------------------- writing


def roles(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, first) of pages whose payload another page also has.

    ``first`` is the smallest page_id with that payload.  Sums are partial per task, so one
    payload on a third of all pages is no hot spot; only ids and digests move.
    """
    own = pages.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    shared = own.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1").select("sha", "first")
    return own.select("page_id", "sha").join(shared, "sha").where("first IS NOT NULL AND NOT page_id <=> first").distinct()


def record(page_id, url: str | None, payload: bytes, first) -> bytes:
    """One response record, or a revisit of page ``first`` if that is not None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = ["WARC/1.1", "WARC-Type: " + ("response" if first is None else "revisit"), f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        head += [f"WARC-Refers-To: <{_ID}{first}>", f"WARC-Profile: {_PROFILE}"]
    head += ["WARC-Payload-Digest: sha1:" + digest(payload), "WARC-Block-Digest: sha1:" + digest(block), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes, level: int = 6) -> bytes:
    """A record as one gzip member, or several of up to 8 MiB of content each."""
    out = []
    for i in range(0, len(data), _PART):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append(z.compress(data[i : i + _PART]) + z.flush())
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, records_per_file: int = 4000) -> None:
    """Write a record per row of ``pages`` (page_id, url, payload string) to files under ``path``.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id
    is a response and the others revisit it; all others are responses.  A null payload is
    empty, a null url is left out.  Repeated rows give repeated records; rows
    without a page_id are never referred to.
    """
    pages = pages.select("page_id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    found = roles(pages, least_bytes=least_bytes)
    keyed = pages.withColumn("sha", F.sha1("payload"))
    joined = keyed.join(found.withColumnRenamed("page_id", "_page"), (keyed["sha"] == found["sha"]) & F.col("page_id").eqNullSafe(F.col("_page")), "left").select("page_id", "url", "payload", "first")

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = zip(b["page_id"].to_pylist(), b["url"].to_pylist(), binary(b["payload"]), b["first"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([members(record(*r))[:-1] for r in rows], pa.binary())], ["member"])

    rows = joined.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


# ---------------------------------------------------------------- reading


def _member(data: memoryview, start: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``start``; its checksum is checked."""
    z, out, at = zlib.decompressobj(31), [], start
    try:
        while not z.eof:
            piece = data[at : at + 32768]
            if not piece:
                raise Damaged("gzip member is cut off")
            out.append(z.decompress(piece))
            at += len(piece)
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    return b"".join(out), at - len(z.unused_data)


def _headers(data: bytes, start: int) -> tuple[dict[str, str], int]:
    """Named fields of the header at ``start`` (after a first line), and where it ends."""
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise Damaged("header has no end")
    fields: dict[str, str] = {}
    for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def _parsed(data: bytes, start: int) -> tuple[dict, int]:
    """The record at ``start`` of uncompressed ``data``, checked, and its end."""
    if not _VERSION.match(data, start):
        raise Damaged("no version line")
    fields, at = _headers(data, start)
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not (length.isascii() and length.isdigit()):
        raise Damaged("header lacks WARC-Type or Content-Length")
    end = at + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record doesn't end where Content-Length says")
    block = data[at:end]
    said = fields.get("warc-block-digest", "")
    if said.lower().startswith("sha1:") and said[5:].upper() != digest(block):
        raise Damaged("block digest differs")
    payload, full = block, len(block)
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, body = _headers(block, 0)
        payload, full = block[body:], len(block) - body
        if fields["warc-type"] == "revisit" and http.get("content-length", "").isdigit():
            full = int(http["content-length"])
    said = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "revisit":
        own = said[5:].upper() if said.lower().startswith("sha1:") else None
    else:
        own = digest(payload)
        if said.lower().startswith("sha1:") and said[5:].upper() != own:
            raise Damaged("payload digest differs")
    return {"fields": fields, "payload": payload, "payload_bytes": full, "payload_digest": own}, end + 4


def _at(data: memoryview, raw: bytes, start: int) -> tuple[dict, int]:
    if raw[start : start + 3] != b"\x1f\x8b\x08":
        return _parsed(raw, start)
    content, end = _member(data, start)
    while True:  # a long record goes on in further members
        try:
            found, used = _parsed(content, 0)
            break
        except Damaged as e:
            if len(content) < _PART or raw[end : end + 3] != b"\x1f\x8b\x08" or not str(e).startswith(("record doesn't end", "header has no end")):
                raise
            more, after = _member(data, end)
            if _VERSION.match(more):
                raise
            content, end = content + more, after
    if used != len(content):
        raise Damaged("member holds more than a record")
    return found, end


def salvage(raw: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, None) or (start, end, None, reason) for all bytes of an archive, in order.

    What isn't a whole record that passes its checks is quarantined: from there
    the next gzip member or version line is sought at which a whole one stands.
    """
    data, at, lost, reason = memoryview(raw), 0, None, None
    while at < len(raw):
        try:
            found, end = _at(data, raw, at)
        except Damaged as e:
            if lost is None:
                lost, reason = at, str(e)
            after = _START.search(raw, at + 1)
            at = after.start() if after else len(raw)
            continue
        if lost is not None:
            yield lost, at, None, reason
            lost = None
        yield at, end, found, None
        at = end
    if lost is not None:
        yield lost, len(raw), None, reason


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives under ``path``, gzipped by member or plain.

    One row each: file, start, end (byte range), gap_reason (null for records),
    record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest,
    and payload if asked for.  An empty file has no rows.  Memory is bounded by an
    archive file and its longest record.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = "file string, start long, end long, gap_reason string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def bare(value: str | None) -> str | None:
        return value.strip("<>") if value else None

    def run(batches: Batches) -> Batches:
        for b in batches:
            for i in range(b.num_rows):
                rows, held = [], 0
                for start, end, r, reason in salvage(b["content"][i].as_py()):
                    f = r["fields"] if r else {}
                    row = (b["path"][i].as_py(), start, end, reason, f.get("warc-type"), bare(f.get("warc-record-id")), f.get("warc-target-uri"), bare(f.get("warc-refers-to")), r and r["payload_bytes"], r and r["payload_digest"])
                    rows.append(row + (r and r["payload"],) if payloads else row)
                    held += end - start
                    if held > _PART:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, schema)


def page_of(record_id):
    """The page_id in a record id that ``write_archives`` made."""
    return F.expr(f"try_cast(substring({record_id}, {len(_ID) + 1}) AS BIGINT)")
