from __future__ import annotations

import hashlib
import io
import zlib

import pytest

from tidewater.llm import warc


def make(k: int, body: bytes) -> bytes:
    return warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{k}>", "WARC-Block-Digest": "sha256:" + hashlib.sha256(body).hexdigest()}, body)


def squeeze(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


BODIES = [bytes([65 + k]) * (50 + 300 * k) + b"WARC/1.0\r\n\x1f\x8b\x08 inside" for k in range(6)]


def read(data: bytes) -> list[warc.Found]:
    return list(warc.salvage(warc.Source(io.BytesIO(data), len(data))))


def covers(found: list[warc.Found], size: int) -> bool:
    at = 0
    for x in found:
        if x.offset != at:
            return False
        at += x.length
    return at == size


@pytest.mark.parametrize("zipped", [True, False])
def test_whole(zipped):
    parts = [make(k, b) for k, b in enumerate(BODIES)]
    data = b"".join(squeeze(p) if zipped else p for p in parts)
    found = read(data)
    assert [x.payload for x in found] == BODIES and covers(found, len(data))
    assert [x.headers["warc-record-id"] for x in found] == [f"<urn:page:{k}>" for k in range(6)]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("hurt", range(6))
def test_each_record_damaged_in_turn(zipped, hurt):
    """Whatever single byte of a record is wrong, the others come back and the gap is that record's bytes."""
    parts = [make(k, b) for k, b in enumerate(BODIES)]
    parts = [squeeze(p) if zipped else p for p in parts]
    p = parts[hurt]
    head = p.find(b"\r\n\r\n")  # of a plain record's headers the version, the length and the digest are checked
    for at in {0, 3, len(p) // 3, len(p) // 2, len(p) - 1} if zipped else {0, 3, head - 1, head + 2, head + 4, (head + len(p)) // 2, len(p) - 1}:
        bad = [*parts]
        bad[hurt] = p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1 :]
        data = b"".join(bad)
        found = read(data)
        assert covers(found, len(data))
        records = [x.payload for x in found if x.kind == "record"]
        if len(records) == 6:  # a bit of the gzip header that no check covers, such as its time stamp
            assert zipped and records == BODIES
            continue
        assert records == BODIES[:hurt] + BODIES[hurt + 1 :]
        gaps = [x for x in found if x.kind == "gap"]
        assert sum(x.length for x in gaps) == len(p) and all(x.reason for x in gaps)


@pytest.mark.parametrize("zipped", [True, False])
def test_junk_truncation_and_lost_beginning(zipped):
    parts = [squeeze(make(k, b)) if zipped else make(k, b) for k, b in enumerate(BODIES)]
    data = b"junk" + parts[0] + b"\x00WARC/1.0\r\nno" + parts[1] + parts[2][:-7]
    found = read(data)
    assert covers(found, len(data))
    assert [x.payload for x in found if x.kind == "record"] == BODIES[:2]
    assert read(b"") == []
    assert [x.kind for x in read(b"nothing here")] == ["gap"]


def payloads(data: bytes) -> list[bytes]:
    found = read(data)
    assert covers(found, len(data))
    return [x.payload for x in found if x.kind == "record"]


def test_plain_file_whose_damaged_start_holds_a_gzip_stream():
    parts = [make(0, squeeze(b"a web page")), *(make(k, b) for k, b in enumerate(BODIES))]
    for start in (b"XXXXX" + parts[0][5:], parts[0][5:]):
        assert payloads(start + b"".join(parts[1:])) == BODIES


@pytest.mark.parametrize("junk", [b"", b"junk", b"\x1f\x8b\x08WARC/1.0\r\n"])
def test_members_and_plain_records_in_one_file(junk):
    for first in (0, 1):
        parts = [squeeze(make(k, b)) if k % 2 == first else make(k, b) for k, b in enumerate(BODIES)]
        assert payloads(junk.join([b"", *parts])) == BODIES


def test_several_records_in_a_member():
    parts = [make(k, b) for k, b in enumerate(BODIES)]
    data = squeeze(b"".join(parts[:4])) + squeeze(parts[4]) + squeeze(parts[5])
    assert payloads(data) == BODIES
    for hurt in range(3):
        bad = [p[:-9] + b"?" + p[-8:] if k == hurt else p for k, p in enumerate(parts[:3])]
        data = squeeze(b"".join(bad)) + squeeze(parts[3])
        assert payloads(data) == [b for k, b in enumerate(BODIES[:4]) if k != hurt]
        assert [x.reason for x in read(data) if x.kind == "gap"] == ["in a member: block digest differs"]


@pytest.mark.parametrize("zipped", [True, False])
def test_limits_are_named(zipped, monkeypatch):
    monkeypatch.setattr(warc, "MAX_RECORD", 2000)
    monkeypatch.setattr(warc, "MAX_HEADER", 500)
    wide = warc.record({"WARC-Type": "resource", "X": "y" * 600}, b"")
    for big in (make(1, bytes(5000)), wide):
        data = b"".join(squeeze(p) if zipped else p for p in (make(0, BODIES[0]), big, make(2, BODIES[1])))
        assert payloads(data) == BODIES[:2]
        assert [x.reason.startswith("limit: ") for x in read(data) if x.kind == "gap"] == [True]


def test_tables(spark, tiny, tmp_path):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    files = warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(files)
    assert {(r.record_id, bytes(r.payload).decode()) for r in got.collect()} == {(f"<urn:page:{r.page_id}>", r.html) for r in pages.collect()}
    damaged = warc.damaged_crawl(spark, pages).collect()
    marks = {r.page_id: hashlib.md5(r.url.encode()).hexdigest()[0] for r in pages.collect()}
    assert sum(r.kind == "record" for r in damaged) == sum(m != "0" for m in marks.values())
    assert all(r.reason and r.length > 0 for r in damaged if r.kind == "gap")


def test_edges(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "http://a b", "", "x"), (1, "http://a b", "", "x"), (2, "u", "long " * 400_000, "x")], "page_id long, url string, html string, path string")
    files = warc.write_warc(pages, f"file://{tmp_path}/w", compress=False)
    got = warc.read_warc(files).collect()
    assert sorted((r.record_id, r.target_uri or "", len(r.payload)) for r in got) == sorted([("<urn:page:None>", "", 0), ("<urn:page:1>", "http://a%20b", 0), ("<urn:page:1>", "http://a%20b", 0), ("<urn:page:2>", "u", 2_000_000)])
    (tmp_path / "empty.warc").touch()
    paths = spark.createDataFrame([(None,), (f"{tmp_path}/empty.warc",)], "path string")
    assert warc.read_warc(paths).count() == 0
    assert warc.read_warc(paths.limit(0)).count() == 0
    assert warc.recovered_pages(spark, pages.limit(0)).count() == 0
