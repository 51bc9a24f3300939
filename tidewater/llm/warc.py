"""WARC files: a writer, and a reader that salvages what damage leaves.

The reader walks a file member by member (gzip) or record by record (plain).
Every record must pass its checks: the member inflates and its CRC holds, the
version line and Content-Length are there, the block is whole, the closing blank
lines follow, and the block digest, where given, agrees. After a failed check
the reader searches for the next place where a valid record begins - a gzip
magic or a version line, whichever is nearer and passes all the checks - and
logs the bytes between as a quarantined gap. A member may hold several records. Files are read in bounded blocks; one file is one unit of
work, and files spread over the tasks.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm._frame import Placed, materialise, open_path, work_path

BLOCK = 4 << 20
MAX_HEADER = 64 << 10
MAX_RECORD = 1 << 30
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
RECORDS = "path string, kind string, offset long, length long, warc_type string, record_id string, target_uri string, warc_date string, payload binary, reason string"


@dataclass
class Found:
    """A record, or a gap of quarantined bytes."""

    kind: str
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    reason: str | None = None


class Bad(Exception):
    """A failed check."""


class Source:
    """Random access to a file by blocks."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at, self.held = handle, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at``."""
        n = max(0, min(n, self.size - at))
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.handle.seek(at)
            self.at, self.held = at, self.handle.read(max(n, min(BLOCK, self.size - at)))
        return self.held[at - self.at : at - self.at + n]

    def find(self, pattern: bytes, at: int) -> int:
        """The next place of a pattern, or the file's end."""
        while at < self.size:
            inside = self.at <= at < self.at + len(self.held) - len(pattern)
            part = self.held[at - self.at :] if inside else self.get(at, BLOCK)
            k = part.find(pattern)
            if k >= 0:
                return at + k
            if at + len(part) >= self.size:
                break
            at += len(part) - len(pattern) + 1
        return self.size


def parse_headers(head: bytes) -> dict[str, str]:
    if not _VERSION.match(head):
        raise Bad("no version line")
    out: dict[str, str] = {}
    last = None
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif text:
            name, colon, value = text.partition(":")
            if not colon:
                raise Bad("malformed header line")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def content_length(headers: dict[str, str]) -> int:
    n = headers.get("content-length", "")
    if not n.isascii() or not n.isdigit():
        raise Bad("no valid Content-Length")
    if int(n) > MAX_RECORD:
        raise Bad(f"limit: block longer than {MAX_RECORD} bytes")
    return int(n)


def check_digest(headers: dict[str, str], block: bytes) -> None:
    name, _, value = headers.get("warc-block-digest", "").partition(":")
    if name.lower() in ("sha1", "sha256", "md5") and value:
        digest = hashlib.new(name.lower(), block).digest()
        if value.lower() != digest.hex() and value.upper().rstrip("=") != base64.b32encode(digest).decode().rstrip("="):
            raise Bad("block digest differs")


def _endless(size: int) -> str:
    return "no end of headers" if size < MAX_HEADER else f"limit: no end of headers within {MAX_HEADER} bytes"


def parse_record(data: bytes, at: int = 0) -> tuple[int, dict[str, str], bytes]:
    """End, headers and block of the whole record at a place."""
    end = data.find(b"\r\n\r\n", at, at + MAX_HEADER)
    if end < 0:
        raise Bad(_endless(len(data) - at))
    headers = parse_headers(data[at:end])
    n = content_length(headers)
    block = data[end + 4 : end + 4 + n]
    if len(block) < n:
        raise Bad("truncated block")
    if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise Bad("no closing blank lines")
    check_digest(headers, block)
    return end + 8 + n, headers, block


def member_records(data: bytes) -> list[tuple[dict[str, str], bytes] | str]:
    """The records of an inflated member until its bytes end; between them, the reason where bytes were skipped."""
    k, out, bad = 0, [], None
    while k < len(data) or not out:
        try:
            k, headers, block = parse_record(data, k)
        except Bad as error:
            if bad is None:
                bad = str(error)
                out.append(bad)
            k = data.find(VERSION, k + 1)
            if k < 0:
                break
        else:
            bad = None
            out.append((headers, block))
    if all(isinstance(x, str) for x in out):
        raise Bad(out[0])
    return out


def gzip_records(source: Source, at: int) -> tuple[int, list[tuple[dict[str, str], bytes] | str]]:
    """End of the member at a place, and what it holds."""
    if source.get(at, 3) != MAGIC:
        raise Bad("no gzip magic")
    inflate, out, total, pos = zlib.decompressobj(31), [], 0, at
    while not inflate.eof:
        part = source.get(pos, 16 << 10)
        if not part:
            raise Bad("truncated member")
        try:
            out.append(inflate.decompress(part))
        except zlib.error as error:
            raise Bad("member does not inflate") from error
        total += len(out[-1])
        if pos == at and total >= 7 and not out[0].startswith(VERSION):
            raise Bad("no version line")
        if total > MAX_RECORD:
            raise Bad(f"limit: member inflates to more than {MAX_RECORD} bytes")
        pos += len(part)
    return pos - len(inflate.unused_data), member_records(b"".join(out))


def plain_record(source: Source, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
    head = source.get(at, MAX_HEADER)
    end = head.find(b"\r\n\r\n")
    if end < 0:
        raise Bad("no version line" if not head.startswith(VERSION) else _endless(len(head)))
    n = content_length(parse_headers(head[:end]))
    _, headers, block = parse_record(source.get(at, end + 4 + n + 4))
    return at + end + 4 + n + 4, [(headers, block)]


def salvage(source: Source) -> Iterator[Found]:
    """Records and gaps of a file, in order; together they cover every byte.

    Members and plain records may follow each other in any order. Of several
    records in a member the first has the member's length, the others 0, as has
    a gap inside a member that holds a valid record.
    """
    at, bad_from, reason = 0, None, None
    signs = {MAGIC: -1, VERSION: -1}
    while at < source.size:
        try:
            end, records = (gzip_records if source.get(at, 2) == MAGIC[:2] else plain_record)(source, at)
        except Bad as error:
            if bad_from is None:
                bad_from, reason = at, str(error)
            for sign, place in signs.items():
                if place <= at:
                    signs[sign] = source.find(sign, at + 1)
            at = min(signs.values())
            continue
        if bad_from is not None:
            yield Found("gap", bad_from, at - bad_from, reason=reason)
            bad_from = None
        for x in records:
            if isinstance(x, str):
                yield Found("gap", at, 0, reason=f"in a member: {x}")
            else:
                yield Found("record", at, end - at, *x)
                at = end
    if bad_from is not None:
        yield Found("gap", bad_from, source.size - bad_from, reason=reason)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, inner = open_path(path)
            rows, held = [], 0
            with system.open_input_file(inner) as handle:
                for x in salvage(Source(handle, handle.size())):
                    h = x.headers
                    rows.append((path, x.kind, x.offset, x.length, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), x.payload, x.reason))
                    held += len(x.payload or b"")
                    if held > BLOCK or len(rows) >= 4096:
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()]
    names = ["path", "kind", "offset", "length", "warc_type", "record_id", "target_uri", "warc_date", "payload", "reason"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(paths: DataFrame) -> DataFrame:
    """Records and quarantined gaps (``kind`` record or gap) of the files named by the column ``path``.

    Null paths are skipped, a path named twice is read twice, an empty file has
    neither records nor gaps, and a file that can't be opened fails the query.
    No paths give no rows. Records whose header lacks a field have a null there.
    A block longer than ``MAX_RECORD`` (1 GiB), a member that inflates to more,
    and headers longer than ``MAX_HEADER`` (64 KiB) are not read but quarantined,
    though they may be valid; the reason of such a gap begins with ``limit``.
    Extra columns are not looked at.
    """
    named = Placed(paths, "path").only().where("path is not null")
    return named.mapInArrow(_read, RECORDS)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, compress: bool, damage):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = open_path(folder)
        system.create_dir(inner, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * compress
        n = 0
        with system.open_output_stream(os.path.join(inner, name), compression=None) as out:
            for batch in batches:
                for key, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    block = (body or "").encode()
                    headers = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{key}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "text/html"}
                    if url is not None:
                        headers["WARC-Target-URI"] = re.sub(r"\s", "%20", url)
                    headers["WARC-Block-Digest"] = "sha256:" + hashlib.sha256(block).hexdigest()
                    data = record(headers, block)
                    if compress:
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = squeeze.compress(data) + squeeze.flush()
                    out.write(damage(key, url, data) if damage else data)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, compress: bool = True, damage=None) -> DataFrame:
    """Writes one WARC file per partition of ``pages`` (page_id, url, html) and returns (path, records).

    The result is a written table, so only files of tasks that succeeded are
    listed and nothing is written twice. A null html is an empty block, a null
    url no target, a null page_id the id ``None``. ``damage`` (key, url, bytes)
    may change a record's bytes, for tests of the reader.
    """
    plain = Placed(pages, "page_id", "url", "html").only()
    return materialise(plain.mapInArrow(_write(folder, compress, damage), "path string, records long"), "warcs")


def injure(key, url: str | None, data: bytes) -> bytes:
    """Damage by the digest of the url: of 16 records one has a byte flipped and one has junk before it."""
    mark = hashlib.md5((url or "").encode()).hexdigest()[0]
    if mark == "0":
        k = len(data) // 2
        return data[:k] + bytes([data[k] ^ 0x55]) + data[k + 1 :]
    return b"\x1f\x8b\x08junk WARC/1.0\r\n" + data if mark == "1" else data


def damaged_crawl(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """All pages through files with damage, read again: records and gaps."""
    return read_warc(write_warc(pages, work_path(spark, "crawl"), damage=injure))


def recovered_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, html_md5, html_bytes) of the records that a damaged crawl still gives."""
    got = damaged_crawl(spark, pages).where("kind = 'record'")
    return got.select(F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.md5("payload").alias("html_md5"), F.octet_length("payload").cast("long").alias("html_bytes"))
