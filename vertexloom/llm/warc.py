"""WARC archives: a writer of per-record gzip members and a salvage reader.

Writing: payloads of MIN_REVISIT bytes or more that are equal are stored once, with the smallest page_id, as a response; the
others are revisit records that name it. Records are packed to gzip members in Python and written by Spark's own text writer,
which works on any file system Spark reaches and commits files whole, so a lost executor leaves no half archive. The writer
ends a row with a separator; here that is the byte 0 that ends each member anyway (the top byte of the size field; a record of
16 MiB or more is followed by an empty member, which ends so too). The files are plain .warc.gz.

Reading: every file is read by Spark's binaryFile source (archives hold at most FILE_BYTES of payload) and walked by ``salvage``:
a member must inflate with its checksum, a record start with a version line, hold its whole block, and match its block digest.
After a failed check the reader searches on for the next gzip magic or version line from which a valid record can be read, goes on
from there, and logs the bytes between as a quarantined gap. It does so inside members as well: of a damaged member, all that
inflates is searched, valid records are kept, and the gaps between them are logged with their places in the inflated bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.session import settings, shared_path, written

MIN_REVISIT = 100
RECORDS_PER_FILE = 5_000
#: Payload bytes of a file, at most (but for a larger single page), and the payload size from which files hold fewer pages.
FILE_BYTES = 64 << 20
STEP = 1 << 15
PIECE = 1 << 14
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date, so that archives are the same whenever they are written.
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


@dataclass
class Record:
    """A record read back; ``start`` and ``end`` are its bytes in the file."""

    headers: dict[str, str]
    block: bytes
    start: int = 0
    end: int = 0

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        """The block's HTTP body, or the whole block if it isn't an HTTP message."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


@dataclass
class Gap:
    """Quarantined bytes and why the record at their start failed; ``inner``: their place in the member's inflated bytes."""

    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


def _uri(text: str) -> str:
    return quote(text, safe="!#$%&'()*+,/:;=?@[]-._~", errors="replace")


def record_bytes(kind: str, record_id: str, block: bytes, headers: dict[str, str]) -> bytes:
    """One uncompressed record."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **headers, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member (or, from 16 MiB of data on, two) whose last byte is 0."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += packer.compress(b"") + packer.flush()
    return out


def page_record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """The record of a page: a response with its payload, or a revisit without."""
    head = {"WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}", "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        head["WARC-Target-URI"] = _uri(url)
    message = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record_bytes("response", f"urn:page:{page_id}", message + payload, head)
    head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    return record_bytes("revisit", f"urn:page:{page_id}", message, head)


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record that starts at ``at`` and the offset after it; ValueError says which check failed."""
    version = VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", version.end() - 2)
    if stop < 0:
        raise ValueError("headers cut short")
    headers = {}
    for line in data[version.end() : stop].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        raise ValueError("bad content length")
    begin = stop + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block cut short or of another length")
    block = data[begin:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    return Record(headers, block), end + 4


def _member_body(data: bytes, at: int) -> int:
    """Where the deflate data of the gzip member at an offset begin; ValueError if its header is cut short."""
    if len(data) < at + 10:
        raise ValueError("gzip: header cut short")
    flags, body = data[at + 3], at + 10
    if flags & 4:
        body += 2 + int.from_bytes(data[body : body + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            end = data.find(b"\0", body)
            if end < 0:
                raise ValueError("gzip: header cut short")
            body = end + 1
    return body + (2 if flags & 2 else 0)


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the member at an offset holds, the offset after it, and what is wrong: with a fault, all that inflates before it, and
    no offset."""
    body = _member_body(data, at)
    unpacker, view, out, pos = zlib.decompressobj(-15), memoryview(data), [], body
    while not unpacker.eof and pos < len(data):  # by pieces: what a member leaves over is copied
        before, piece = unpacker.copy(), view[pos : pos + PIECE]
        try:
            out.append(unpacker.decompress(piece))
        except zlib.error as e:
            for b in range(len(piece)):  # up to the byte that fails
                try:
                    out.append(before.decompress(piece[b : b + 1]))
                except zlib.error:
                    break
            return b"".join(out), None, f"gzip: {e}"
        pos += len(piece)
    inner = b"".join(out)
    if not unpacker.eof:
        return inner, None, "gzip member cut short"
    end = pos - len(unpacker.unused_data)
    trailer = data[end : end + 8]
    if trailer != struct.pack("<II", zlib.crc32(inner), len(inner) & 0xFFFFFFFF):
        return inner, None, "gzip: checksum or length differs" if len(trailer) == 8 else "gzip member cut short"
    return inner, end + 8, ""


def _walk(data: bytes) -> Iterator[Record | Gap]:
    """The valid records of uncompressed bytes, with their offsets, and the gaps between them."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            record, end = _parse(data, at)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            found = VERSION.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        record.start, record.end = at, end
        yield record
        at = end
    if bad is not None:
        yield Gap(bad, len(data), why)


def _read_at(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """The records of the member or plain record at an offset and the offset after it; ValueError if nothing there is valid.

    In a member, valid records are kept whatever stands between them; gaps inside it have its place in the file and their
    own in the inflated bytes. A damaged member ends at the next place from which a record can be read.
    """
    if not data.startswith(MAGIC, at):
        record, end = _parse(data, at)
        record.start, record.end = at, end
        return [record], end
    inner, end, fault = _inflate(data, at)
    found = list(_walk(inner))
    if (fault or found) and not any(isinstance(r, Record) for r in found):
        raise ValueError(fault or found[0].reason)
    last = max((r.end for r in found if isinstance(r, Record)), default=0)
    if fault:  # what follows the last valid record is the member's fault
        found = [*(r for r in found if r.start < last), Gap(last, len(inner), fault)]
    stop = end if end is not None else _next(data, at + 1)
    for r in found:
        if isinstance(r, Gap):
            r.inner = (r.start, r.end)
        r.start, r.end = at, stop
    return found, stop


_PROBE = re.compile(re.escape(MAGIC) + rb"|WARC/1\.[01]\r\n")


def _next(data: bytes, at: int) -> int:
    """The first offset from ``at`` on at which a record or a member with one can be read, or the end."""
    while found := _PROBE.search(data, at):
        at = found.start()
        try:
            if data.startswith(MAGIC, at):
                inner, _, fault = _inflate(data, at)
                if not fault and not inner or any(isinstance(r, Record) for r in _walk(inner)):
                    return at
            else:
                _parse(data, at)
                return at
        except ValueError:
            pass
        at += 1
    return len(data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of a file in order, and the gaps between them. Plain records and gzip members may be mixed."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            found, end = _read_at(data, at)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            probe = _PROBE.search(data, at + 1)
            at = probe.start() if probe else len(data)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield Gap(bad, len(data), why)


def write_pages(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", text_column: str = "html", min_revisit: int = MIN_REVISIT, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a record per page below ``path``.

    Null texts are empty payloads. Rows with a null id are always responses. Rows that repeat an id and a payload are alike:
    all responses, or all revisits. An empty table writes no record. A payload that a third of the pages share is found by a
    pre-aggregated minimum; only its digest is joined back, and rows of short payloads are spread by their id.
    """
    raw = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("payload"))
    size = F.octet_length("payload")
    step = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / STEP))).cast("int")

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"value": [member(page_record("" if pd.isna(i) else int(i), u, bytes(p), None if pd.isna(f) else int(f)))[:-1] for i, u, p, f in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["first"], strict=True)]})

    # pages of like size go to the same files, so that FILE_BYTES bounds a file; equal payloads are of one size
    steps = sorted(r["step"] for r in raw.select(step.alias("step")).distinct().collect()) or [0]
    for k in steps:
        rows = (raw.where(step == k) if len(steps) > 1 else raw).withColumn("digest", F.when(size >= min_revisit, F.unhex(F.sha2("payload", 256))))
        rows = rows.withColumn("key", F.coalesce("digest", F.xxhash64("page_id", "url").cast("string").cast("binary")))
        first = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first")
        named = rows.join(first, F.col("key") == F.col("_digest"), "left")
        named = named.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("first"))
        most = max(1, min(records_per_file, FILE_BYTES // (STEP << k)))
        with settings(pages.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(min(500, most))):
            packed = named.mapInPandas(pack, "value binary").select(F.col("value").cast("string").alias("value"))
            packed.write.option("lineSep", "\0").option("maxRecordsPerFile", most).text(f"{path}/step-{k}")


RECORDS = "path string, start long, end long, kind string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, reason string, inner_start long, inner_end long"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record or gap: (path, start, end, kind, record_id, target_uri, refers_to, payload_bytes, payload_digest, payload, reason,
    inner_start, inner_end).

    ``kind`` is the WARC type, or 'gap' with ``reason``; gaps inside a gzip member have the member's bytes as start and end, and
    their place in what inflates as inner ones. Digests of responses are of the payload as read; revisits, which
    have none, give the size and digest of their headers. ``payloads=False`` leaves out the bytes.
    """

    def walk(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                out = []
                for r in salvage(bytes(content)):
                    if isinstance(r, Gap):
                        out.append((name, r.start, r.end, "gap", None, None, None, None, None, None, r.reason, *(r.inner or (None, None))))
                        continue
                    h, body = r.headers, r.payload
                    if r.kind == "revisit":
                        size, digest = int(h.get("x-payload-length", 0)), h.get("warc-payload-digest", "").removeprefix("sha256:")
                    else:
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                    out.append((name, r.start, r.end, r.kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), size, digest, body if payloads else None, None, None, None))
                    if len(out) == 500:
                        yield pd.DataFrame(out, columns=_NAMES)
                        out = []
                yield pd.DataFrame(out, columns=_NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(walk, RECORDS)


_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    path = shared_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"urn:page:(-?\d*)", 1), F.lit("")).cast("long")
    rows = read_archives(spark, path, payloads=False).where("kind in ('response', 'revisit')")
    out = rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number(F.coalesce("refers_to", F.lit(""))).alias("refers_to"))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1"):  # one archive at a time
        return written(out, "records")


SQL = """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, '')))::bigint n from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by h) end first from p)
select page_id, n payload_bytes, sha256(h) payload_digest, case when page_id <> first then 'revisit' else 'response' end record_type,
  case when page_id <> first then first end refers_to from f
"""
