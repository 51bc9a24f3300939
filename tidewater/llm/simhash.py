"""SimHash near-dedup with the nearest-neighbour recursion of May and Ozerov.

A document's fingerprint has 512 bits: the signs of the sums of its distinct
word pairs' hash bits. Fingerprints at a Hamming distance of at most
``max_distance`` are near copies. Candidates come from the recursion: a strip is
a random choice of 32 coordinates; a list is filtered to those fingerprints whose
weight on the strip, after a random shift, is low; each list is filtered again on
strips and shifts of its own until the lists are small, and then all pairs of a
list are compared. The weights and the depth follow from the number of
fingerprints, counted over all, so that a list holds about ``small`` of them;
the number of strips follows from the chance that a pair at the greatest
distance passes a filter together, so that it is met with the target recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _text as tx
from tidewater.llm._frame import Placed, materialise
from tidewater.llm.graph import components, least_labels

BITS, WORDS, BYTES = 512, 8, 64
STRIP, SHIFTS, DEEPER, POOL = 32, 32, 4, 64
#: Greatest weight on the strips of each level, for ever more fingerprints.
WEIGHTS = ((9,), (8,), (7,), (9, 9), (8, 8), (8, 8, 8), (7, 7, 7))
_SALTS = tx.mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


@lru_cache(1)
def _bit_table() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def fingerprint(features: np.ndarray) -> bytes:
    """512 signs of the summed bits of distinct 64-bit features."""
    spread = tx.mix(features[:, None] ^ _SALTS[None, :]).view(np.uint8).reshape(len(features), BYTES)
    cells = (spread + (np.arange(BYTES, dtype=np.int64) * 256)[None, :]).ravel()
    ones = np.bincount(cells, minlength=BYTES * 256).reshape(BYTES, 256).astype(np.float32) @ _bit_table()
    return np.packbits(ones * 2 > len(features), axis=1).tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        buf, offs = tx.utf8(batch.column(1))
        rows, out = [], []
        for i, j in tx.slices(offs):
            part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, ends, first = tx.words(part, at, tx.punctuation())
            h = tx.hashes(part, starts, ends, True)
            pair = tx.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:]) if len(h) > 1 else h[:0]
            for d in range(j - i):
                a, b = first[d], first[d + 1]
                if b > a:
                    rows.append(i + d)
                    out.append(fingerprint(np.unique(pair[a : b - 1] if b - a > 1 else h[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows] if rows else ids[:0], pa.int64()), pa.array(out, pa.binary())], ["id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp) of each document with an id and at least one word."""
    p = Placed(docs, "doc_id", "text")
    plain = p.only().select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    return plain.mapInArrow(_prints, "id long, fp binary")


def share(low: int) -> float:
    """Of all fingerprints, those whose weight on a strip is at most ``low``."""
    return sum(comb(STRIP, i) for i in range(low + 1)) / 2**STRIP


@lru_cache(64)
def chances(low: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """By the number of differing coordinates on the strip: how likely it is, and that both of a pair then pass a filter."""
    likely, both = [], []
    for e in range(min(STRIP, distance) + 1):
        ways = sum(comb(STRIP - e, a) * comb(e, b) for a in range(min(low, STRIP - e) + 1) for b in range(e + 1) if max(a + b, a + e - b) <= low)
        likely.append(comb(distance, e) * comb(BITS - distance, STRIP - e) / comb(BITS, STRIP))
        both.append(ways / 2**STRIP)
    return np.array(likely), np.array(both)


def levels_for(n: int, small: int, distance: int, recall: float) -> list[tuple[int, int]]:
    """(greatest weight, strips) of each level, for n fingerprints."""
    weights = next((w for w in WEIGHTS if n * np.prod([share(x) for x in w]) <= small), WEIGHTS[-1])
    met = 1.0
    for low in reversed(weights[1:]):
        likely, both = chances(low, distance)
        met = 1 - float((likely * (1 - both * met) ** SHIFTS).sum()) ** DEEPER
    likely, both = chances(weights[0], distance)
    miss = float((likely * (1 - both * met) ** SHIFTS).sum())
    return [(weights[0], ceil(log(1 - recall) / log(miss))), *((w, DEEPER) for w in weights[1:])]


@lru_cache(64)
def _strips(seed: int, level: int, count: int) -> np.ndarray:
    rng = np.random.default_rng([seed, level])
    return np.array([rng.choice(BITS, STRIP, replace=False) for _ in range(count)])


def lists_of(bits: np.ndarray, levels: list[tuple[int, int]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for each small list that the recursion puts a row in."""
    rows, keys = np.arange(len(bits)), np.zeros(len(bits), np.uint64)
    for level, (low, count) in enumerate(levels):
        strips, new_rows, new_keys = _strips(seed, level, POOL if level else count), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

        def values(coords: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(np.packbits(bits[:, coords], axis=1)).view(np.uint32).ravel()

        pool = np.stack([values(c) for c in strips]) if level else None
        for s in range(count):
            tag = np.arange(1, SHIFTS + 1, dtype=np.uint64) + np.uint64(SHIFTS * (s + (level << 20)) + (seed << 40))
            if level:
                own = tx.mix(keys + np.uint64(s))
                value = pool[(own % np.uint64(POOL)).astype(np.int64), rows]
                tag = tx.mix(own[:, None] + tag[None, :])
            else:
                value, tag = values(strips[s]), tx.mix(tag)[None, :]
            which, shift = np.nonzero(np.bitwise_count(value[:, None] ^ (tag >> np.uint64(32)).astype(np.uint32)) <= low)
            new_rows.append(rows[which])
            new_keys.append(tag[which if level else 0, shift])
        rows, keys = np.concatenate(new_rows), np.concatenate(new_keys)
    return rows, keys.view(np.int64)


def _scatter(levels: list[tuple[int, int]], seed: int):
    step = 2048 if len(levels) == 1 else 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.slice(start, step)
                fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BYTES)
                rows, keys = lists_of(np.unpackbits(fp, axis=1), levels, seed)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(take), batch.column(1).take(take)], ["key", "id", "fp"])

    return run


def close_pairs(fp: np.ndarray, max_distance: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of the rows of (n, 8) words at a distance of at most max_distance."""
    left, right = [], []
    cols = np.ascontiguousarray(fp.T)
    for a in range(0, len(fp), block):
        b = min(a + block, len(fp))
        d = np.zeros((b - a, len(fp) - a), np.uint16)
        for w in range(WORDS):
            d += np.bitwise_count(cols[w, a:b, None] ^ cols[w, None, a:])
        i, j = np.nonzero(d <= max_distance)
        up = j > i
        left.append(i[up] + a)
        right.append(j[up] + a)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _stars(max_distance: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        fp = np.frombuffer(b"".join(group.column("fp").to_pylist()), np.uint64).reshape(-1, WORDS)[order]
        root = least_labels(len(ids), *close_pairs(fp, max_distance))
        at = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"u": pa.array(ids[at]), "v": pa.array(ids[root[at]])})

    return run


def near_edges(prints: DataFrame, max_distance: int = 120, small: int = 4096, recall: float = 0.9, seed: int = 7) -> DataFrame:
    """Edges (u, v) that join the near copies among ``prints`` (id, fp).

    Equal fingerprints are joined by grouping, and only the least id of each
    goes through the recursion. Of each list the stars of its components are
    kept, not all pairs, so a group of thousands gives thousands of edges.
    """
    prints = materialise(prints, "prints")
    one = prints.groupBy("fp").agg(F.min("id").alias("id"))
    same = prints.join(one.select("fp", F.col("id").alias("v")), "fp").select(F.col("id").alias("u"), "v").where("u <> v")
    n = one.count()
    spread = one.select("id", "fp").mapInArrow(_scatter(levels_for(n, small, max_distance, recall), seed), "key long, id long, fp binary")
    found = spread.groupBy("key").applyInArrow(_stars(max_distance), "u long, v long")
    return found.union(same)


def near_copies(docs: DataFrame, max_distance: int = 120, small: int = 4096, recall: float = 0.9, seed: int = 7) -> DataFrame:
    """(doc_id, kept_doc_id): each document that has a near copy of lesser id, and the least id of its group.

    Groups are the connected components of pairs at most ``max_distance`` of 512
    bits apart; a pair at that very distance is met with the chance ``recall``,
    nearer ones more surely. Texts that are null or without a word, and rows without an id,
    are in no group. Rows that share a doc_id are one document, joined to what
    any of them resembles. An empty table gives no rows. Extra columns are not
    looked at.
    """
    return components(near_edges(fingerprints(docs), max_distance, small, recall, seed)).select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def drop_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without those that ``near_copies`` finds; rows without an id stay."""
    p = Placed(docs, "doc_id", "text")
    gone = near_copies(docs, **parameters).select(F.col("doc_id").alias("__gone"))
    return p.restore(p.df.join(gone, F.col(p["doc_id"]).cast("long") == F.col("__gone"), "left_anti"))
