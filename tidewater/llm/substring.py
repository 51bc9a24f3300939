"""Exact substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Tokens are maximal runs of bytes that aren't ASCII white space. A map task
hashes every window of ``width`` tokens of its documents and sorts them by hash;
each hash range (bucket) of a chunk becomes one row of packed bytes: hash
differences of 6 bytes, window numbers of 3 or 4, and which documents they are in.
So a window costs about 9 bytes of shuffle. The number of buckets follows from the
bytes of all texts, which are summed first, and chunks grow with it. Windows that repeat inside a chunk
travel once (map-side combine), which bounds the rows of a hot window by the
number of chunks. Each bucket counts its windows and gives back those that
occur more than once; per document they merge into maximal intervals.

The first occurrence of a window, by (doc_id, text hash, position), is kept;
all others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _text as tx
from tidewater.llm._frame import Placed

WIDTH = 50
#: Windows of a chunk at least; bytes of text of a bucket; windows of a chunk for each bucket; most buckets.
CHUNK, BUCKET_BYTES, PER_BUCKET, MAX_BUCKETS = 2_000_000, 10 << 20, 64, 250_000
PACKED = "bucket int, hashes binary, places binary, multi binary, docs binary, rest binary"
KEEP, REMOVE = 0, 1
_DOC = np.dtype([("id", "<i8"), ("th", "<i8"), ("start", "<i8")])
_HIT = np.dtype([("id", "<i8"), ("th", "<i8"), ("pos", "<i4"), ("kind", "<i4")])


def _pack_ints(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpack_ints(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def window_hashes(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of all rows in order, and how many each row has."""
    starts, ends, first = tx.words(buf, offs, tx.table())
    h = tx.hashes(buf, starts, ends, False)
    each = np.maximum(np.diff(first) - width + 1, 0)
    if not each.sum():
        return np.zeros(0, np.uint64), each
    at = np.repeat(first[:-1] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
    return tx.rolling(h, width)[at], each


def _chunk_rows(hashes: list[np.ndarray], ids: list[int], ths: list[int], each: list[int], buckets: int) -> pa.RecordBatch:
    h = np.concatenate(hashes)
    docs = np.zeros(len(ids), _DOC)
    docs["id"], docs["th"] = ids, ths
    # windows in the order of their documents, so that the first of a chunk is the least; a repeated row counts once
    starts = np.r_[0, np.cumsum(each)].astype(np.int64)
    rank = np.lexsort((docs["th"], docs["id"]))
    rank = rank[np.r_[True, docs[rank[1:]] != docs[rank[:-1]]]]
    docs, counts = docs[rank], np.asarray(each, np.int64)[rank]
    docs["start"] = np.r_[0, np.cumsum(counts)[:-1]]
    h = h[np.repeat(starts[rank] - docs["start"], counts) + np.arange(counts.sum())]
    order = np.argsort(h, kind="stable")
    sh = h[order]
    new = np.r_[True, sh[1:] != sh[:-1]]
    multi = np.r_[new[:-1] & ~new[1:], False] if len(new) else new
    rest = order[~new]
    sh, order, multi = sh[new], order[new], multi[new]
    cut = np.searchsorted(bucket_of(sh, buckets), np.arange(buckets + 1))
    size = 3 if len(h) < 1 << 24 else 4
    columns: list[list] = [[], [], [], [], [], []]
    spread = rest % buckets
    for b in range(buckets):
        lo, hi = cut[b], cut[b + 1]
        mine = rest[spread == b] if len(rest) else rest
        if lo == hi and not len(mine):
            continue
        part, place = sh[lo:hi], order[lo:hi]
        delta = part[1:] - part[:-1]
        wide = 8 if len(delta) and delta.max() >> np.uint64(48) else 6
        used = np.unique(np.searchsorted(docs["start"], np.r_[place, mine], "right") - 1)
        columns[0].append(b)
        columns[1].append((bytes([wide]) + part[:1].tobytes() + _pack_ints(delta, wide)) if len(part) else b"")
        columns[2].append(bytes([size]) + _pack_ints(place, size))
        columns[3].append(np.packbits(multi[lo:hi]).tobytes())
        columns[4].append(docs[used].tobytes())
        columns[5].append(_pack_ints(mine, 4))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "hashes", "places", "multi", "docs", "rest"])


def _map(width: int, buckets: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        total = 0
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            buf, offs = tx.utf8(batch.column(2))
            for i, j in tx.slices(offs):
                h, each = window_hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                some = np.flatnonzero(each)
                if not len(some):
                    continue
                held[0].append(h)
                held[1].extend(ids[i:j][some])
                held[2].extend(ths[i:j][some])
                held[3].extend(each[some])
                total += len(h)
                if total >= chunk:
                    yield _chunk_rows(*held, buckets)
                    held, total = [[], [], [], []], 0
        if total:
            yield _chunk_rows(*held, buckets)

    return run


def _resolve(docs: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = docs[np.searchsorted(docs["start"], place, "right") - 1]
    return d["id"], d["th"], (place - d["start"]).astype(np.int32)


def _hits(rows: pa.Table) -> np.ndarray:
    """The occurrences of the bucket's repeated windows."""
    hs, multis, places, owners, docs, out = [], [], [], [], [], []
    for k, row in enumerate(zip(*(rows.column(c).to_pylist() for c in ("hashes", "places", "multi", "docs", "rest")), strict=True)):
        raw, place, multi, doc, rest = row
        doc = np.frombuffer(doc, _DOC)
        docs.append(doc)
        if rest:
            hit = np.zeros(len(rest) // 4, _HIT)
            hit["id"], hit["th"], hit["pos"] = _resolve(doc, _unpack_ints(rest, 4).astype(np.int64))
            hit["kind"] = REMOVE
            out.append(hit)
        if raw:
            first, delta = np.frombuffer(raw[1:9], np.uint64), _unpack_ints(raw[9:], raw[0])
            hs.append(np.cumsum(np.r_[first, delta], dtype=np.uint64))
            n = len(hs[-1])
            places.append(_unpack_ints(place[1:], place[0]).astype(np.int64))
            multis.append(np.unpackbits(np.frombuffer(multi, np.uint8), count=n).astype(bool))
            owners.append(np.full(n, k, np.int32))
    if not hs:
        return np.concatenate(out) if out else np.zeros(0, _HIT)
    h, place, multi, owner = (np.concatenate(x) for x in (hs, places, multis, owners))
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    take = np.flatnonzero(np.r_[same, False] | np.r_[False, same] | multi[order])
    h, order = h[take], order[take]
    place, owner, multi = place[order], owner[order], multi[order]
    hit = np.zeros(len(take), _HIT)
    by = np.argsort(owner, kind="stable")
    for k, part in zip(*_groups(owner[by], by), strict=True):
        hit["id"][part], hit["th"][part], hit["pos"][part] = _resolve(docs[k], place[part])
    order = np.lexsort((hit["pos"], hit["th"], hit["id"], h))
    hit, h, multi = hit[order], h[order], multi[order]
    if len(h):
        # a repeated row that fell into several chunks brings the same occurrence again
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (hit[1:] != hit[:-1])])
        hit, h, multi = hit[first], h[first], np.logical_or.reduceat(multi, first)
        same = h[1:] == h[:-1]
        still = np.r_[same, False] | np.r_[False, same] | multi
        hit, h = hit[still], h[still]
    hit["kind"] = np.r_[KEEP, np.where(h[1:] == h[:-1], REMOVE, KEEP)] if len(h) else 0
    return np.concatenate([hit, *out])


def _groups(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(key):
        return key, []
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[cut], np.split(value, cut[1:])


def _reduce(rows: pa.Table) -> pa.Table:
    hit = _hits(rows)
    hit = hit[np.lexsort((hit["pos"], hit["th"], hit["id"]))]
    cut = np.flatnonzero(np.r_[True, (hit["id"][1:] != hit["id"][:-1]) | (hit["th"][1:] != hit["th"][:-1])]) if len(hit) else np.zeros(0, int)
    code = (hit["pos"].astype(np.int64) * 2 + hit["kind"]).astype("<u4")
    return pa.table({"doc_id": pa.array(hit["id"][cut]), "th": pa.array(hit["th"][cut]), "codes": pa.array([x.tobytes() for x in np.split(code, cut[1:])] if len(cut) else [], pa.binary())})


def intervals(positions: np.ndarray, width: int) -> np.ndarray:
    """(start, end) of the union of the windows at sorted positions, overlapping or touching ones merged."""
    if not len(positions):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.r_[True, positions[1:] > positions[:-1] + width])
    last = np.r_[cut[1:], len(positions)] - 1
    return np.stack([positions[cut], positions[last] + width], 1)


def _merge(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, spans = [], [], []
            for i, codes in enumerate(batch.column(2).to_pylist()):
                code = np.unique(np.concatenate([np.frombuffer(c, "<u4") for c in codes]))
                for kind in (KEEP, REMOVE):
                    span = intervals((code[code % 2 == kind] // 2).astype(np.int64), width)
                    rows.append(np.full(len(span), i))
                    kinds.append(np.full(len(span), kind))
                    spans.append(span)
            at, kind, span = (np.concatenate(x) if x else np.zeros((0, 2), np.int64) for x in (rows, kinds, spans))
            at = pa.array(at.ravel().astype(np.int64)) if len(at) else pa.array([], pa.int64())
            kind, span = kind.ravel()[: len(at)], span.reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(span[:, 0]), pa.array(span[:, 1]), pa.array(["remove" if k else "keep" for k in kind], pa.string())],
                ["doc_id", "th", "start_token", "end_token", "action"],
            )

    return run


def _found(docs: DataFrame, width: int, buckets: int | None) -> DataFrame:
    p = Placed(docs, "doc_id", "text")
    plain = p.only().select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").where("doc_id is not null and text is not null")
    if buckets is None:
        size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(max(32, size // BUCKET_BYTES), MAX_BUCKETS)
    packed = plain.mapInArrow(_map(width, buckets, max(CHUNK, PER_BUCKET * buckets)), PACKED)
    hits = packed.groupBy("bucket").applyInArrow(_reduce, "doc_id long, th long, codes binary")
    lists = hits.groupBy("doc_id", "th").agg(F.collect_list("codes").alias("codes"))
    return lists.mapInArrow(_merge(width), "doc_id long, th long, start_token long, end_token long, action string")


def repeated_passages(docs: DataFrame, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """(doc_id, start_token, end_token, n_tokens, action): the maximal intervals covered by repeated windows.

    ``action`` is ``remove`` for intervals of occurrences that aren't the first
    of their window and ``keep`` for those of first occurrences; the two kinds
    can overlap in one document. Null texts, rows without an id, and texts of
    fewer than ``width`` tokens give no rows; an empty table gives none. Windows
    may repeat within one document. Rows equal in id and text are one document
    and don't repeat each other; rows that share an id but not the text are
    two. Extra columns are not looked at.
    """
    found = _found(docs, width, buckets)
    return found.select("doc_id", "start_token", "end_token", (F.col("end_token") - F.col("start_token")).alias("n_tokens"), "action")


def cut_tokens(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the tokens of the sorted spans, and without the white space after them."""
    raw = text.encode()
    buf = np.frombuffer(raw, np.uint8)
    starts, _, _ = tx.words(buf, np.array([0, len(buf)]), tx.table())
    at = np.r_[starts, len(raw)]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a]])
        done = max(done, at[b])
    return b"".join([*out, raw[done:]]).decode()


def _apply(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(spans_at).to_pylist()
            if not any(spans):
                yield batch
                continue
            texts = batch.column(text_at)
            new = [cut_tokens(t.as_py(), sorted((x["start_token"], x["end_token"]) for x in s)) if s else t.as_py() for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[text_at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def drop_repeats(docs: DataFrame, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """The documents, their later occurrences of repeated windows cut out; ``n_chars`` follows the text where there is one.

    A text that is all repeats becomes empty; its row stays. Rows without an id
    or a text stay as they are.
    """
    p = Placed(docs, "doc_id", "text")
    spans = _found(docs, width, buckets).where("action = 'remove'").groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("start_token", "end_token")).alias("__spans"))
    key = F.col(p["doc_id"]).cast("long")
    joined = p.df.join(spans, (key == F.col("__id")) & (F.xxhash64(p["text"]) == F.col("__th")), "left").select(*p.private, "__spans")
    cut = joined.mapInArrow(_apply(p.private.index(p["text"]), len(p.private)), joined.schema)
    return p.restore(with_length(cut, p))


def with_length(df: DataFrame, p: Placed) -> DataFrame:
    """``n_chars`` set anew, where the documents have that column."""
    at = [c for c, name in zip(p.private, p.original, strict=True) if name == "n_chars"]
    return df.withColumn(at[0], F.length(p["text"]).cast(dict(p.df.dtypes)[at[0]])) if at else df
