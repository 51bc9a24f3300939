from __future__ import annotations

import hashlib
import struct
import tarfile

from tidewater.llm import media

PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\x08\x02" + bytes(5000)
GIF = b"GIF89a" + struct.pack("<HH", 12, 34) + bytes(90)
BMP = b"BM" + bytes(16) + struct.pack("<ii", 5, 6) + bytes(20)
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF" + bytes(10) + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 77, 88) + bytes(40)
HTML = '<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>Été</title></head><body>'.encode() + b"text " * 4000
PAYLOADS = [PNG, GIF, BMP, JPEG, HTML, b"", b"%PDF-1.7", b"\x00\x01rest"]


def test_metadata_needs_only_the_head():
    want = [("image/png", 640, 480), ("image/gif", 12, 34), ("image/bmp", 5, 6), ("image/jpeg", 88, 77), ("text/html", None, None), (None, None, None), ("application/pdf", None, None), ("application/octet-stream", None, None)]
    for p, (kind, w, h) in zip(PAYLOADS, want, strict=True):
        for head in (p, p[: media.HEAD]):
            got = media.sniff(head)
            assert (got["media_type"], got["width"], got["height"]) == (kind, w, h)
    got = media.sniff(HTML[: media.HEAD])
    assert (got["language"], got["charset"], got["title"]) == ("fr", "utf-8", "Été")


def test_round_trip_and_shards(spark, tmp_path):
    rows = [(k, p) for k, p in enumerate(PAYLOADS * 3)] + [(None, PNG), (50, None)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "key long, body binary, digest string, shard string").repartition(3)
    got = media.media_columns(df, "key", "body", f"file://{tmp_path}/shards", shard_bytes=8000).cache()
    by = {}
    for r in got.collect():
        by.setdefault(r.key, r)
    for k, p in rows:
        r = by[k]
        if p is None:
            assert r.digest is None and r.shard is None and r.offset is None
            continue
        assert r.digest == hashlib.sha256(p).hexdigest() and r.raw_length == len(p)
    assert got.count() == len(rows)
    catalog = got.where("digest is not null").select("digest", "shard", "offset", "length", "encoding").distinct()
    assert catalog.count() == len(PAYLOADS)
    back = {r.digest: bytes(r.payload) for r in media.fetch(catalog).collect()}
    assert set(back.values()) == set(PAYLOADS)
    names = {(r.shard, r.digest): r for r in catalog.collect()}
    for (shard, digest), r in names.items():
        with tarfile.open(shard.removeprefix("file://")) as t:
            member = next(m for m in t.getmembers() if m.name.split(".")[0] == digest)
            assert member.offset_data == r.offset and member.size == r.length


def test_edges(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, html string, url string")
    assert media.page_media(df, f"file://{tmp_path}/a").count() == 0
    df = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 3_000_000), (2, "x" * 3_000_000)], "page_id long, html string")
    got = media.page_media(df, f"file://{tmp_path}/b").collect()
    assert sorted(str((r.page_id, r.raw_length)) for r in got) == sorted(map(str, [(1, None), (None, 0), (2, 3_000_000), (2, 3_000_000)]))


def test_page_table(spark, tiny, tmp_path):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    got = media.page_media(pages, f"file://{tmp_path}/c")
    back = {r.digest: bytes(r.payload).decode() for r in media.fetch(got.select("digest", "shard", "offset", "length", "encoding").distinct()).collect()}
    digests = {r.page_id: r.digest for r in got.collect()}
    assert all(back[digests[r.page_id]] == r.html for r in pages.collect())
