"""WARC archives: a writer with revisits, and a reader that salvages damaged files.

The reader takes plain files and files of one gzip member per record. After a check fails
(gzip data, version line, header, length, digest) it searches for the next place where a record
with sound checks begins, goes on from there, and reports the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from controlweave.llm.tables import batch, filesystem, partitions, prepared, written
from controlweave.session import fresh_folder

#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 100
#: A new archive is begun once one holds so many bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: A header block larger than this is taken as damage.
HEADER_LIMIT = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def record(kind: str, page_id: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit holds the HTTP header only, whose Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', uri)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[1:1] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_ARCHIVES = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_ARCHIVES_DDL = "archive string, records bigint, bytes bigint"


def write_archives(
    pages: DataFrame, folder: str | None = None, id_column: str = "page_id", uri_column: str = "url", body_column: str = "html",
    date: datetime | None = None, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row and return the archives (``archive``, ``records``, ``bytes``).

    Null bodies are empty. Of rows with equal bodies of at least 100 bytes the one with the
    smallest id is a response and the others are revisits of it; rows that repeat that id, and
    rows without an id, are responses too. Only listed archives belong to the result; files of
    lost attempts don't. An empty table gives no archives; other columns are ignored.
    """
    spark = prepared(pages.sparkSession)
    folder = folder or fresh_folder(spark, "warc")
    when = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = pages.select(
        pages[id_column].cast("bigint").alias("page_id"),
        F.coalesce(pages[uri_column].cast("string"), F.lit("")).alias("uri"),
        F.coalesce(pages[body_column].cast("binary"), F.lit(b"")).alias("body"),
    ).withColumn("digest", F.sha2("body", 256))
    large = F.length("body") >= REVISIT_BYTES
    repeated = own.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    # only digests with copies meet; a digest with very many copies is a hot key that adaptive execution splits
    joined = own.join(repeated.select("digest", "first_id"), "digest", "left")
    revisit = F.coalesce(large & (F.col("page_id") != F.col("first_id")), F.lit(False))
    rows = joined.select("page_id", "uri", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), "body")

    def store(batches) -> Iterator[pa.RecordBatch]:
        files, place = filesystem(folder)
        out, name, count, size, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", count, size))

        for part in batches:
            for row in part.to_pylist():
                if out is None:
                    files.create_dir(place, recursive=True)
                    name, count, size = f"{uuid.uuid4().hex}.warc{'.gz' * compress}", 0, 0
                    out = files.open_output_stream(f"{place}/{name}", compression=None)
                kind = "response" if row["refers_to"] is None else "revisit"
                data = record(kind, row["page_id"], row["uri"], row["body"], row["digest"], row["refers_to"], when)
                data = member(data) if compress else data
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield batch(_ARCHIVES, [[d[k] for d in done] for k in range(3)])

    return written(rows.mapInArrow(store, _ARCHIVES_DDL), "archives")


class Damage(ValueError):
    """A check that failed; the message names it."""


@dataclass
class Parsed:
    """One record of an archive and the bytes it takes up there."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        """The body of an HTTP message, else the whole block."""
        if "application/http" not in self.headers.get("content-type", ""):
            return self.block
        head, _, body = self.block.partition(b"\r\n\r\n")
        return body


class Window:
    """A stream of which a moving part is kept: all bytes from ``base`` on that were read."""

    def __init__(self, stream) -> None:
        self.stream, self.base, self.data, self.ended = stream, 0, bytearray(), False

    def fill(self, upto: int) -> bool:
        """Have the bytes before ``upto``, if the stream holds them."""
        while not self.ended and self.base + len(self.data) < upto:
            more = self.stream.read(READ_BYTES)
            self.ended = not more
            self.data += more
        return self.base + len(self.data) >= upto

    def drop(self, before: int) -> None:
        if before > self.base:
            del self.data[: before - self.base]
            self.base = before

    def at(self, start: int, end: int) -> bytes:
        return bytes(self.data[start - self.base : end - self.base])


def _headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not _VERSION.match(lines[0] + b"\r\n"):
        raise Damage("no version line")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damage("broken header line")
        last = name.strip().decode("utf-8", "replace").lower()
        if last in out and last != "warc-concurrent-to":  # the rest of one header before the next
            raise Damage("repeated header field")
        out[last] = value.strip().decode("utf-8", "replace")
    if not _MANDATORY <= out.keys():
        raise Damage("missing header field")
    return out


def _digest_fits(value: str, data: bytes) -> bool:
    """Whether labelled digest and data agree; algorithms not known here are not checked."""
    label, _, given = value.partition(":")
    name = label.lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5"):
        return True
    digest = hashlib.new(name, data).digest()
    return given.lower() == digest.hex() or given.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _checked(parsed: Parsed) -> Parsed:
    value = parsed.headers.get("warc-block-digest")
    if value and not _digest_fits(value, parsed.block):
        raise Damage("block digest differs")
    value = parsed.headers.get("warc-payload-digest")
    if value and parsed.headers.get("warc-type") == "response" and not _digest_fits(value, parsed.payload):
        raise Damage("payload digest differs")
    return parsed


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not value.isdigit():
        raise Damage("no content length")
    return int(value)


def _plain_record(window: Window, start: int) -> Parsed:
    """The record that begins at a version line."""
    reach = 4096
    while True:
        whole = window.fill(start + reach)
        head = window.at(start, start + reach)
        cut = head.find(b"\r\n\r\n")
        if cut >= 0:
            break
        if not whole or reach >= HEADER_LIMIT:
            raise Damage("no end of header")
        reach *= 4
    headers = _headers(head[:cut])
    begin = start + cut + 4
    end = begin + _length(headers)
    # a length can be damage: believe it only as far as the file goes
    if not window.fill(end):
        raise Damage("record runs past the end")
    if window.fill(end + 4) and window.at(end, end + 4) != b"\r\n\r\n":
        raise Damage("no end of record")
    return _checked(Parsed(start, min(end + 4, window.base + len(window.data)), headers, window.at(begin, end)))


def _gzip_record(window: Window, start: int) -> Parsed:
    """The record of the gzip member that begins here."""
    unpack, out, at = zlib.decompressobj(31), bytearray(), start
    while not unpack.eof:
        if not window.fill(at + 1):
            raise Damage("gzip member runs past the end")
        part = window.at(at, at + READ_BYTES)
        try:
            out += unpack.decompress(part)
        except zlib.error as error:
            raise Damage(f"gzip: {error}") from None
        at += len(part)
        if not out.startswith(b"WARC/"[: len(out)]):
            raise Damage("no version line")
    end = at - len(unpack.unused_data)
    cut = out.find(b"\r\n\r\n", 0, HEADER_LIMIT)
    if cut < 0:
        raise Damage("no end of header")
    headers = _headers(bytes(out[:cut]))
    size = _length(headers)
    if len(out) - cut - 4 < size:
        raise Damage("record is shorter than its length")
    return _checked(Parsed(start, end, headers, bytes(out[cut + 4 : cut + 4 + size])))


def _next_start(window: Window, start: int) -> int | None:
    """The next place at or after ``start`` that looks like the begin of a record."""
    while True:
        window.fill(start + READ_BYTES)
        data = window.at(start, start + READ_BYTES)
        if len(data) < 3:
            return None
        places = [p for p in (data.find(_GZIP), data.find(b"WARC/1.")) if p >= 0]
        if places:
            return start + min(places)
        start += max(1, len(data) - 6)
        window.drop(start)
        if window.ended and start + 3 > window.base + len(window.data):
            return None


@dataclass
class Gap:
    """Bytes of an archive that belong to no sound record, and the check that failed there."""

    start: int
    end: int
    reason: str


def salvage(stream) -> Iterator[Parsed | Gap]:
    """All sound records of an archive, in order, and the gaps between them.

    Holds one record at a time. An empty file gives nothing.
    """
    window, at, open_gap, reason = Window(stream), 0, None, ""
    while window.fill(at + 1):
        window.drop(at if open_gap is None else min(at, window.base + len(window.data)))
        try:
            start = window.at(at, at + 3)
            if start == _GZIP:
                found = _gzip_record(window, at)
            elif window.fill(at + 7) and window.at(at, at + 7) == b"WARC/1.":
                found = _plain_record(window, at)
            else:
                raise Damage("no member or version line")
        except Damage as damage:
            if open_gap is None:
                open_gap, reason = at, str(damage)
            following = _next_start(window, at + 1)
            if following is None:
                break
            at = following
            continue
        if open_gap is not None:
            yield Gap(open_gap, at, reason)
            open_gap = None
        yield found
        at = found.end
    if open_gap is not None:
        window.fill(1 << 62)
        yield Gap(open_gap, window.base + len(window.data), reason)


_READ = pa.schema([
    ("archive", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("payload", pa.binary()), ("reason", pa.string()),
])
READ_DDL = (
    "archive string, kind string, start bigint, end bigint, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_bytes bigint, payload_digest string, payload binary, reason string"
)


def _row(archive: str, found: Parsed | Gap, with_payload: bool) -> list:
    if isinstance(found, Gap):
        return [archive, "gap", found.start, found.end, None, None, None, None, None, None, None, found.reason]
    h, kind = found.headers, found.headers.get("warc-type")
    if kind == "revisit":
        # of the payload a revisit tells the digest and, in its HTTP header, the length
        length = _HTTP_LENGTH.search(found.block)
        size, digest = int(length[1]) if length else None, h.get("warc-payload-digest", "").partition(":")[2] or None
        payload = None
    else:
        payload = found.payload
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return [archive, "record", found.start, found.end, kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), size, digest, payload if with_payload else None, None]


def read_archives(archives: DataFrame, path_column: str = "archive", with_payload: bool = True) -> DataFrame:
    """Records and gaps of the listed archives.

    ``kind`` is record or gap; ``start`` and ``end`` are byte positions in the file. A record has
    its type, id, target, ``refers_to``, ``payload`` (none for revisits), and the length and SHA-256
    of the full payload; a gap has the reason, the check that failed first. Null paths are ignored.
    """
    spark = prepared(archives.sparkSession)
    paths = archives.select(archives[path_column].alias("archive")).where("archive IS NOT NULL")

    def read(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for uri in part.column(0).to_pylist():
                files, path = filesystem(uri)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for found in salvage(stream):
                        rows.append(_row(uri, found, with_payload))
                        held += len(rows[-1][10] or b"")
                        if len(rows) >= 256 or held >= 4 << 20:
                            yield batch(_READ, list(zip(*rows, strict=True)))
                            rows, held = [], 0
                if rows:
                    yield batch(_READ, list(zip(*rows, strict=True)))

    return paths.repartition(partitions(spark), "archive").mapInArrow(read, READ_DDL)


def page_number(column: str) -> Column:
    """The id in a record id that :func:`write_archives` gave."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
