"""Media columns: content-addressed payloads in tar shards, and metadata from header-only range reads.

Every task writes the payloads it holds to tar shards of its own in the shared
folder, each under the SHA-256 of its bytes, so payloads are never shuffled. The
rows of the table carry digest, shard, offset and length, not payloads. One
catalog entry per digest is kept: the least (shard, offset) where several tasks
met the same payload. Payloads that shrink are stored as a zlib stream.
Metadata columns come from the first ``HEAD`` bytes at the offset, whatever the
payload's length.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._frame import Placed, materialise, open_path, work_path

HEAD = 2048
SHARD_BYTES = 256 << 20
PLACES = "digest string, shard string, offset long, length long, raw_length long, encoding string"
META = f"{PLACES}, media_type string, width int, height int, language string, charset string, title string"
_LANG = re.compile(rb"<html[^>]*?\blang=[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(rb"<meta[^>]*?\bcharset=[\"']?([\w-]+)", re.I)
_TITLE = re.compile(rb"<title[^>]*>(.*?)</title>", re.I | re.S)


def encode(payload: bytes) -> tuple[bytes, str]:
    """Bytes to store, and how: a zlib stream where that is smaller by a tenth."""
    small = zlib.compress(payload, 6)
    return (small, "zlib") if len(small) < 0.9 * len(payload) else (payload, "raw")


def decode(stored: bytes, encoding: str, most: int | None = None) -> bytes:
    """The payload, or its beginning from the beginning of what is stored."""
    if encoding == "raw":
        return stored if most is None else stored[:most]
    return zlib.decompressobj().decompress(stored, most or 0)


def sniff(head: bytes) -> dict:
    """Type and metadata from the first bytes of a payload; what they don't show is None."""
    out: dict = dict.fromkeys(("media_type", "width", "height", "language", "charset", "title"))
    text = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    if head.startswith(b"\x89PNG\r\n\x1a\n") and len(head) >= 24:
        out["media_type"], (out["width"], out["height"]) = "image/png", struct.unpack(">II", head[16:24])
    elif head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        out["media_type"], (out["width"], out["height"]) = "image/gif", struct.unpack("<HH", head[6:10])
    elif head.startswith(b"BM") and len(head) >= 26:
        out["media_type"], (out["width"], out["height"]) = "image/bmp", struct.unpack("<ii", head[18:26])
    elif head.startswith(b"\xff\xd8\xff"):
        out["media_type"], at = "image/jpeg", 2
        while at + 9 <= len(head) and head[at] == 0xFF:
            mark, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                out["height"], out["width"] = struct.unpack(">HH", head[at + 5 : at + 9])
                break
            at += 2 + size
    elif head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        out["media_type"] = "audio/wav"
    elif head.startswith(b"%PDF-"):
        out["media_type"] = "application/pdf"
    elif text[:15].lower().startswith((b"<!doctype html", b"<html")):
        out["media_type"] = "text/html"
        for name, r in (("language", _LANG), ("charset", _CHARSET), ("title", _TITLE)):
            if m := r.search(head):
                out[name] = m[1].decode("utf-8", "replace")
    elif head:
        out["media_type"] = "application/octet-stream"
    return out


def _store(folder: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = open_path(folder)
        system.create_dir(inner, recursive=True)
        raw = name = None
        at, known = 0, {}
        for batch in batches:
            rows = []
            for payload in batch.column(0).to_pylist():
                if payload is None:
                    continue
                payload = payload.encode() if isinstance(payload, str) else payload
                digest = hashlib.sha256(payload).hexdigest()
                if digest in known:
                    continue
                known[digest] = True
                if raw is None:
                    name, at = f"shard-{uuid.uuid4().hex}.tar", 0
                    raw = system.open_output_stream(os.path.join(inner, name), compression=None)
                stored, how = encode(payload)
                info = tarfile.TarInfo(digest + (".z" if how == "zlib" else ""))
                info.size = len(stored)
                raw.write(info.tobuf(tarfile.USTAR_FORMAT))
                raw.write(stored + b"\0" * (-len(stored) % 512))
                rows.append((digest, f"{folder}/{name}", at + 512, len(stored), len(payload), how))
                at += 512 + len(stored) + -len(stored) % 512
                if at >= shard_bytes:
                    raw.write(b"\0" * 1024)
                    raw.close()
                    raw, known = None, {}
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in rows], schema=_PLACES)
        if raw is not None:
            raw.write(b"\0" * 1024)
            raw.close()

    return run


_NAMES = ["digest", "shard", "offset", "length", "raw_length", "encoding"]
_PLACES = pa.schema(list(zip(_NAMES, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)))
_SNIFFED = [("media_type", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("language", pa.string()), ("charset", pa.string()), ("title", pa.string())]


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = handle = None
    for batch in batches:
        found = []
        for shard, offset, length, how in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "encoding")), strict=True):
            if shard != path:
                system, inner = open_path(shard)
                path, handle = shard, system.open_input_file(inner)
            handle.seek(offset)
            found.append(sniff(decode(handle.read(min(length, HEAD)), how, HEAD)))
        meta = [pa.array([f[n] for f in found], k) for n, k in _SNIFFED]
        yield pa.RecordBatch.from_arrays([*batch.columns, *meta], [*_NAMES, *(n for n, _ in _SNIFFED)])


def store(payloads: DataFrame, column: str, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the payloads of a string or binary column and returns the catalog with metadata, one row per digest.

    The catalog is a written table, so only shards of tasks that succeeded are
    named in it. Null payloads are not stored, empty ones are. An empty table
    gives an empty catalog.
    """
    places = materialise(Placed(payloads, column).only().mapInArrow(_store(folder, shard_bytes), PLACES), "places")
    least = F.min(F.struct("shard", "offset", "length", "raw_length", "encoding"))
    one = places.groupBy("digest").agg(least.alias("p")).select("digest", "p.*")
    return materialise(one.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(_heads, META), "media")


def media_columns(rows: DataFrame, key: str, column: str, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, digest, shard, offset, length, raw_length, encoding, metadata...) for every row.

    A null payload has nulls in all the other columns. Repeated payloads share
    one digest and one place. Repeated rows and null keys stay as they are;
    extra columns are not looked at.
    """
    catalog = store(rows, column, folder, shard_bytes)
    p = Placed(rows, key, column)
    digests = p.df.select(F.col(p[key]).alias("__key"), F.sha2(F.col(p[column]).cast("binary"), 256).alias("__digest"))
    out = digests.join(catalog, F.col("__digest") == F.col("digest"), "left").drop("__digest")
    return out.withColumnRenamed("__key", key)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = handle = None
    for batch in batches:
        out = []
        for shard, offset, length, how in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
            if shard is None:
                out.append(None)
                continue
            if shard != path:
                system, inner = open_path(shard)
                path, handle = shard, system.open_input_file(inner)
            handle.seek(offset)
            out.append(decode(handle.read(length), how))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["digest", "payload"])


def fetch(catalog: DataFrame) -> DataFrame:
    """(digest, payload) of catalog rows; a null place gives a null payload."""
    return Placed(catalog, "digest", "shard", "offset", "length", "encoding").only().mapInArrow(_fetch, "digest string, payload binary")


def page_media(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Media columns of the html of ``pages``."""
    return media_columns(pages, "page_id", "html", folder or work_path(pages.sparkSession, "shards"))
