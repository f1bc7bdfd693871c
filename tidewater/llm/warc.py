"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing. A record is one gzip member. Archives go through Spark's own text writer, so any
store that Spark can write to will do: a member's last byte is the top of its 32-bit length
and is zero below 16 MiB, and that zero is what the writer puts between rows. (Longer records
are closed by an empty member of their own, which also ends in zero.) Equal payloads are
found by digest: the key and the largest id are aggregated before the shuffle, and only payloads
that may be recorded once are joined with them. Files are bounded in bytes: the writer gets rows
of members up to ``UNIT`` bytes, a longer record is followed by empty members, a row for each
further unit, and no file takes more than ``UNITS_PER_FILE`` rows.

Reading. Members are checked in turn: gzip's own checksum, the version line, the header, the
length of the block and the payload's digest. After a failed check the reader searches for
the next place where a member opens with a version line (in plain files: the next version
line), goes on from there, and logs the gap. A task holds one archive file at a time (Spark's
binaryFile source gives whole files, at most 2 GiB), so its memory is bounded by the file: about
``UNIT * UNITS_PER_FILE`` bytes, or one longer record, for archives written here.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

VERSION = b"WARC/1.1"
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads from this many bytes on are recorded once.
REVISIT_FROM = 1000
#: Bytes of members in a row of the writer, and rows in an archive file.
UNIT, UNITS_PER_FILE = 1 << 20, 64


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has the HTTP header only, and the digest and length of the full payload."""
    head = [VERSION.decode()]
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head += [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte, a zero, is left to the writer."""
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = gz.compress(data) + gz.flush()
    if out[-1]:
        out += EMPTY_MEMBER
    return out[:-1]


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages (page_id, url, html)`` to ``path``.

    Of rows with equal payloads of at least ``REVISIT_FROM`` bytes the one with the largest id
    is the response (all of them, if that id repeats) and the others revisit it. Nulls: no html
    is an empty payload; rows without an id are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.cast("binary").alias("body"), F.sha1(payload.cast("binary")).alias("digest"))
    large = F.octet_length("body") >= REVISIT_FROM
    copies = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    to = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    records = rows.where(large).join(copies, "digest", "left").select("page_id", "url", "body", "digest", to.alias("refers_to"))
    records = records.unionByName(rows.where(~large).withColumn("refers_to", F.lit(None).cast(records.schema["refers_to"].dataType)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            # a unit is its members, each but the last with the zero that the writer leaves out
            units = [b"\0".join(held)] + [EMPTY_MEMBER[:-1]] * (size // UNIT)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(units, type=pa.binary())], names=["m"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = member(record(*row, date))
                if held and size + len(one) > UNIT:
                    yield flush()
                    size = 0
                held.append(one)
                size += len(one)
                if size >= UNIT:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    members = records.mapInArrow(build, "m binary")
    members.select(F.col("m").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", UNITS_PER_FILE).text(path)


def _digest_agrees(own: bytes, want: str) -> bool:
    """Is a SHA-1 in hex or base32 the same? A text of another form can't be checked and passes."""
    if re.fullmatch("[0-9a-fA-F]{40}", want):
        return own.hex() == want.lower()
    if re.fullmatch("[a-zA-Z2-7]{32}", want):
        return base64.b32encode(own).decode() == want.upper()
    return True


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of one record; ValueError names the check that fails."""
    end = data.find(b"\r\n\r\n")
    if not re.match(rb"WARC/[0-9]+\.[0-9]+\r\n", data) or end < 0:
        raise ValueError("version line or header")
    try:
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in data[:end].decode().split("\r\n")[1:])}
        size = int(head["content-length"])
    except (ValueError, KeyError):
        raise ValueError("header") from None
    block = data[end + 4 : end + 4 + size]
    if size < 0 or len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("block length")
    if head.get("warc-type") == "response" and (want := head.get("warc-payload-digest", "")).startswith("sha1:"):
        body = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
        if not _digest_agrees(hashlib.sha1(body).digest(), want[5:]):
            raise ValueError("payload digest")
    return head, block


def _inflate(raw: memoryview, at: int, most: int) -> tuple[bytes, int]:
    """One gzip member from ``at``; ValueError on damage."""
    gz, out, size, pos = zlib.decompressobj(31), [], 0, at
    try:
        while not gz.eof:
            part = raw[pos : pos + (1 << 16)]
            if not len(part):
                raise ValueError("truncated member")
            got = gz.decompress(part)
            pos += len(part)
            size += len(got)
            if size > most:
                raise ValueError("record too long")
            out.append(got)
    except zlib.error:
        raise ValueError("gzip member") from None
    return b"".join(out), pos - len(gz.unused_data)


def _opens(raw: memoryview, at: int) -> bool:
    """Does a member at this place begin with a version line?"""
    try:
        return zlib.decompressobj(31).decompress(raw[at : at + 512], 8)[:5] == b"WARC/"
    except zlib.error:
        return False


def salvage(data: bytes, most: int = 1 << 30) -> Iterator[tuple]:
    """``(kind, start, end, reason, header, block)``: kind is record or gap, in file order.

    Works on gzip members and on plain records, also mixed. Every byte is in one record or gap,
    but for what separates records. ``most`` bounds the unpacked size of a record.
    """
    raw, at, gap, why = memoryview(data), 0, -1, ""
    n = len(data)
    while at < n:
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                text, end = _inflate(raw, at, most)
                if not text:  # an empty member says nothing
                    at = end
                    continue
                head, block = parse(text)
            elif data[at : at + 5] == b"WARC/":
                stop = data.find(b"\r\n\r\n", at)
                size = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", data[at : stop + 2]) if stop >= 0 else None
                if not size:
                    raise ValueError("header")
                end = stop + 8 + int(size[1])
                head, block = parse(data[at:end])
            elif gap < 0 and data[at : at + 1] in (b"\r", b"\n", b"\0"):
                at += 1
                continue
            else:
                raise ValueError("no record")
        except ValueError as e:
            if gap < 0:
                gap, why = at, str(e)
            at = _next(data, raw, at + 1)
            continue
        if gap >= 0:
            yield "gap", gap, at, why, None, None
            gap = -1
        yield "record", at, end, None, head, block
        at = end
    if gap >= 0:
        yield "gap", gap, n, why, None, None


def _next(data: bytes, raw: memoryview, at: int, window: int = 1 << 20) -> int:
    """The next place where a member opens with a version line, or a version line stands."""
    version = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
    for lo in range(at, len(data), window):
        hi = min(len(data), lo + window)
        line = version.search(data, lo, min(len(data), hi + 32))
        stop = line.start() if line else hi
        member_at = data.find(b"\x1f\x8b\x08", lo, stop + 2)
        while member_at >= 0 and not _opens(raw, member_at):
            member_at = data.find(b"\x1f\x8b\x08", member_at + 1, stop + 2)
        if member_at >= 0 or line:
            return member_at if member_at >= 0 else stop
    return len(data)


def read(spark: SparkSession, path: str, payloads: bool = False, most: int = 1 << 30) -> DataFrame:
    """Records and gaps of all archives under ``path``.

    ``kind`` (record or gap), ``file, start_byte, end_byte, reason``, and of records ``page_id,
    url, record_type, payload_digest, payload_bytes, refers_to`` (with ``payloads`` also
    ``payload``). Read through Spark's binaryFile source, a file a row. A record of over ``most``
    unpacked bytes is a gap, with that reason.
    """
    names = ["kind", "file", "start_byte", "end_byte", "reason", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    if payloads:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def number(text: str | None) -> int | None:
        m = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", text or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for kind, start, end, why, head, block in salvage(data.as_py() or b"", most):
                    if kind == "gap":
                        row = (kind, file, start, end, why, *[None] * (len(names) - 5))
                    else:
                        body = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
                        digest, of = head.get("warc-payload-digest"), head.get("x-payload-length")
                        length = int(of) if (of or "").isdigit() else len(body)
                        row = (kind, file, start, end, None, number(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-type"), digest.removeprefix("sha1:") if digest else None, length, number(head.get("warc-refers-to")))
                        if payloads:
                            row += (body,)
                            size += len(body)
                    rows.append(row)
                    if len(rows) >= 5000 or size > 1 << 24:
                        yield flush()
                        size = 0
        if rows:
            yield flush()

    ddl = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{n} {ddl[k]}" for n, k in zip(names, kinds, strict=True)))


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes in what ``read`` gives: ``file, start_byte, end_byte, reason``."""
    return records.where("kind = 'gap'").select("file", "start_byte", "end_byte", "reason")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder and read them back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to`` a record.

    Defined results: an empty table gives no rows; repeated rows give a record each; extra
    columns are not read. A gap in what was just written is an error, never a shorter result.
    """
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession)
    write(pages.select("page_id", "url", "html"), path)
    found = cut(read(spark, path))
    if not found.where("kind = 'gap'").isEmpty():
        raise OSError(f"archives under {path} are damaged")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> first THEN first END AS refers_to
FROM m
"""
