"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

Each pre-token is a row of bytes. A segment tree over its positions holds the
rank of the pair that begins there; the root shows the least rank, and the
descent that prefers the left child finds its leftmost place. A merge makes the
pair's right part dead, and updates the tree at three points: the dead position
and the two live neighbours' pairs. So a pre-token of n bytes takes O(n log n).

Short pre-tokens are encoded together, one tree each, in lockstep over numpy
arrays; long ones one by one. Distinct pre-tokens are encoded once per task and
kept in a bounded table.
"""

from __future__ import annotations

import base64
import bisect
import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _text as tx
from tidewater.llm._frame import Placed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
NONE = np.int32(2**31 - 1)
TOGETHER = 64
KEPT = 150_000
#: Token ids that are decoded at a time, unless a single text has more.
DECODED = 1 << 18


class Vocabulary:
    """Ranks of the byte strings of a vocabulary, and of the pairs that make them."""

    def __init__(self, lines: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.size = max(ranks.values()) + 1
        pieces = [b""] * self.size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.offs = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.r_[keys, np.int64(2**62)]
        self.made = np.r_[np.array([pairs[k] for k in keys.tolist()], np.int32), NONE]

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for those that aren't merged."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NONE)


def encode_one(v: Vocabulary, piece: bytes) -> np.ndarray:
    """Token ids of a pre-token, by its own segment tree."""
    n = len(piece)
    token = v.byte[np.frombuffer(piece, np.uint8)]
    if n < 2:
        return token
    leaves = 1 << (n - 2).bit_length() if n > 2 else 1
    level = np.full(leaves, NONE, np.int32)
    level[: n - 1] = v.rank(token[:-1], token[1:])
    levels = [level]
    while len(level) > 1:
        level = np.minimum(level[::2], level[1::2])
        levels.append(level)
    tree = [int(NONE)] + np.concatenate(levels[::-1]).tolist()
    token, after, before = token.tolist(), list(range(1, n + 1)), list(range(-1, n))
    keys, made, none = v.keys, v.made, int(NONE)

    def rank(a: int, b: int) -> int:
        key = a << 32 | b
        at = keys.searchsorted(key)
        return int(made[at]) if keys[at] == key else none

    def put(leaf: int, value: int) -> None:
        node = leaves + leaf
        tree[node] = value
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low
            node >>= 1

    while tree[1] != none:
        node = 1
        while node < leaves:
            node = 2 * node + (tree[2 * node] > tree[2 * node + 1])
        i = node - leaves
        j = after[i]
        k = after[j]
        token[i], after[i] = tree[1], k
        if k < n:
            before[k] = i
        token[j] = -1
        if j < n - 1:
            put(j, none)
        put(i, rank(token[i], token[k]) if k < n else none)
        if before[i] >= 0:
            put(before[i], rank(token[before[i]], token[i]))
    return np.array([t for t in token if t >= 0], np.int32)


def encode_together(v: Vocabulary, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All token ids, and how many each has, of pre-tokens of at most ``width`` bytes, ``width`` a power of two: all trees in lockstep."""
    w = len(pieces)
    size = np.array([len(p) for p in pieces], np.int32)
    raw = np.zeros((w, width + 1), np.uint8)
    inside = np.arange(width + 1)[None, :] < size[:, None]
    raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    token = np.where(inside, v.byte[raw], 0)
    tree = np.full((w, 2 * width), NONE, np.int32)
    pair = inside[:, 1:]
    tree[:, width:][pair] = v.rank(token[:, :-1][pair], token[:, 1:][pair])
    node = width
    while node > 1:
        half = node // 2
        tree[:, half:node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
        node = half
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (w, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int32), (w, 1))
    live = inside.copy()

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = width + leaf
        tree[rows, node] = value
        while True:
            node = node >> 1
            if not node[0]:
                break
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        node = np.ones(len(rows), np.int64)
        while node[0] < width:
            node = 2 * node + (tree[rows, 2 * node] > tree[rows, 2 * node + 1])
        i = node - width
        j = after[rows, i]
        k = after[rows, j]
        token[rows, i] = tree[rows, 1]
        after[rows, i] = k
        live[rows, j] = False
        more = k < size[rows]
        before[rows[more], k[more]] = i[more]
        dead = j < width
        put(rows[dead], j[dead], np.full(dead.sum(), NONE)) if dead.any() else None
        rank = np.full(len(rows), NONE, np.int32)
        rank[more] = v.rank(token[rows[more], i[more]], token[rows[more], k[more]])
        put(rows, i, rank)
        b = before[rows, i]
        left = b >= 0
        if left.any():
            put(rows[left], b[left], v.rank(token[rows[left], b[left]], token[rows[left], i[left]]))
        rows = rows[tree[rows, 1] != NONE]
    return token[live], live.sum(1)


class Encoder:
    """Encodes texts; distinct pre-tokens are kept, up to ``KEPT`` of them at a time."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, kept: int = KEPT):
        self.v, self.find, self.kept = vocabulary, regex.compile(pattern).findall, kept
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: set[str]) -> None:
        new = words - self.index.keys()
        if not new:
            return
        raw = sorted(((x.encode(), x) for x in new), key=lambda x: len(x[0]))
        pieces = [p for p, _ in raw]
        wide = [1 << max(0, (len(p) - 1).bit_length()) for p in pieces]
        flat, sizes, a = [self.flat], [], 0
        while a < len(pieces):
            width = wide[a]
            if width > TOGETHER:
                flat.append(encode_one(self.v, pieces[a]))
                sizes.append([len(flat[-1])])
                a += 1
                continue
            b = min(a + max(1, (1 << 18) // width), bisect.bisect_right(wide, width))
            ids, each = encode_together(self.v, pieces[a:b], width)
            flat.append(ids)
            sizes.append(each)
            a = b
        base = len(self.index)
        self.index.update(zip((x for _, x in raw), range(base, base + len(raw)), strict=True))
        self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(np.concatenate(sizes))])
        self.flat = np.concatenate(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin."""
        parts, counts = [], []
        for t in texts:
            found = self.find(t)
            parts += found
            counts.append(len(found))
        words = set(parts)
        if len(self.index) + len(words) > self.kept:
            self.clear()
        self.learn(words)
        at = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        size = self.offs[at + 1] - self.offs[at]
        ends = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(self.offs[at] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.r_[0, np.cumsum(counts)].astype(np.int64)]


def decode(v: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids, and where each text's bytes begin."""
    if len(ids) and (ids.min() < 0 or ids.max() >= v.size):
        raise ValueError("a token id is not in the vocabulary")
    size = v.offs[ids + 1] - v.offs[ids]
    ends = np.r_[0, np.cumsum(size)]
    return v.flat[np.repeat(v.offs[ids] - ends[:-1], size) + np.arange(ends[-1])], ends[offs]


def _encode(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            column = batch.column(1)
            buf, offs = tx.utf8(column)
            for i, j in tx.slices(offs, 1 << 20):
                part = column.slice(i, j - i)
                ids, cut = encoder.encode(["" if t is None else t for t in part.to_pylist()])
                back, ends = decode(shared.value, ids, cut)
                same = np.array_equal(ends, offs[i : j + 1] - offs[i]) and np.array_equal(back, buf[offs[i] : offs[j]])
                null = part.is_null()
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids), mask=null if part.null_count else None)
                count = pa.array(np.diff(cut), pa.int64(), mask=null.to_numpy(zero_copy_only=False) if part.null_count else None)
                if not same:
                    raise ValueError("decoding does not give the text back")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), count, lists], ["doc_id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document; each result is decoded again and must give the text's bytes.

    A null text has null ids and an empty one none. Strings of special tokens
    are ordinary text. Repeated rows and null ids of documents stay as they are;
    an empty table gives no rows. Extra columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    plain = Placed(docs, "doc_id", "text").only().select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(_encode(shared, pattern), "doc_id long, n_tokens long, ids array<int>")


def _texts(v: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Strings of the ids of some rows, straight from the bytes unless some aren't UTF-8."""
    raw, ends = decode(v, ids, offs)
    try:
        codecs.utf_8_decode(raw.data, "strict", True)
        whole = not ((raw[ends[1:-1][ends[1:-1] < len(raw)]] & 0xC0) == 0x80).any()  # no row may begin within a character
    except UnicodeDecodeError:
        whole = False
    if not whole:
        return pa.array([raw[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offs = column.offsets.to_numpy().astype(np.int64)
            ids, null = column.values, column.is_null()
            sizes = np.where(null.to_numpy(zero_copy_only=False), 0, np.diff(offs))
            for i, j in tx.slices(np.r_[0, np.cumsum(sizes)], DECODED):
                kept = null.slice(i, j - i)
                if kept.true_count:
                    # a null row may have ids beneath it
                    part = column.slice(i, j - i).flatten()
                else:
                    part = ids.slice(offs[i], offs[j] - offs[i])
                if part.null_count:
                    raise ValueError("a token id is null")
                texts = _texts(shared.value, part.to_numpy().astype(np.int64), np.r_[0, np.cumsum(sizes[i:j])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pc.if_else(kept, None, texts) if kept.true_count else texts], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of token ids; null ids give a null text, bytes that aren't UTF-8 become U+FFFD, an unknown id fails."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    return Placed(encoded, "doc_id", "ids").only().mapInArrow(_decode(shared), "doc_id long, text string")
