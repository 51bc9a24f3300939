"""Toxicity by a factorization machine over hashed terms.

score(x) = bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j over the distinct
hashed words and word beginnings of a document. The pairwise part learns what an additive model
can't, such as an insult that counts only beside the mention of a group. Terms
enter for what they tell alone or for what a pair of them tells together.
Training uses a bounded sample of labelled documents (``max_train``, the least
hashes of doc_id); scoring covers every document whole. The model has a fixed
size, so broadcasting it doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _text as tx
from tidewater.llm._frame import Placed

SLOTS = 1 << 18
FACTORS = 8
MAX_TRAIN = 8000
TERMS = 2000
LEAST_CHI = 12.0
#: Toxic rows in which the two terms of a pair meet, at least. Fewer can't be told from chance.
LEAST_PAIR = 8
PAIR_BLOCK = 1024
FOLDS = 3
#: Bytes of the beginnings of words that are terms too, so that inflected forms share weights.
STEMS = (5, 6, 7, 8)


def slots_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word and of its beginnings (words x terms), and where each row's words begin."""
    starts, ends, first = tx.words(buf, offs, tx.punctuation())
    whole = tx.hashes(buf, starts, ends, True)
    terms = [whole]
    for size in STEMS:
        stem = tx.hashes(buf, starts, np.minimum(ends, starts + size), True) ^ np.uint64(size)
        terms.append(np.where(ends - starts > size, stem, whole))
    return (np.stack(terms, 1) >> np.uint64(46)).astype(np.int32), first


def term_slots(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The distinct hashed words, and beginnings of words, of each row."""
    slot, first = slots_of(buf, offs)
    return [np.unique(slot[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


@dataclass
class Machine:
    """Weights of the terms that training chose; all other slots weigh nothing."""

    bias: float
    index: np.ndarray  # slot -> row of w and v, 0 for none
    w: np.ndarray
    v: np.ndarray
    threshold: float = 0.0

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self._score(self.index[r]) for r in rows])

    def _score(self, at: np.ndarray) -> float:
        at = at[at > 0]
        if not len(at):
            return self.bias
        v = self.v[at]
        total = v.sum(0)
        return float(self.bias + self.w[at].sum() + 0.5 * (total @ total - (v * v).sum()))


def distinct_rows(rows: list[np.ndarray], bands: int = 4, depth: int = 4) -> np.ndarray:
    """Indices of the rows without the near copies of earlier ones, by banded min-hashes.

    Copies of one labelled document would otherwise make its chance words look
    like evidence, and let the held-out rows confirm it.
    """
    seen: set[tuple] = set()
    out = []
    salts = tx.mix(np.arange(1, bands * depth + 1, dtype=np.uint64))
    for i, r in enumerate(rows):
        if not len(r):
            continue
        least = tx.mix(r.astype(np.uint64)[:, None] ^ salts).min(0)
        keys = [(b, *least[b * depth : (b + 1) * depth].tolist()) for b in range(bands)]
        if not any(k in seen for k in keys):
            out.append(i)
        seen.update(keys)
    return np.array(out, int)


def choose_terms(rows: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """Slots of the greatest chi-square against the label, at least ``LEAST_CHI``, found in at least 5 rows."""
    n, pos = max(len(y), 1), y.sum()
    every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    mine = np.concatenate([r for r, t in zip(rows, y, strict=True) if t] or [np.zeros(0, np.int64)])
    df, dp = np.bincount(every, minlength=SLOTS), np.bincount(mine, minlength=SLOTS)
    expected = df * pos / n
    chi = np.where(df >= 5, (dp - expected) ** 2 / np.maximum(expected * (1 - pos / n), 1e-9), 0)
    top = np.lexsort((np.arange(SLOTS), -chi))[:most]
    return np.sort(top[chi[top] >= LEAST_CHI])


def _excess(d: np.ndarray, c: np.ndarray, q: np.ndarray | float) -> np.ndarray:
    """Chernoff's bound on the chance of d or more toxic rows among c at the rate q, as a negative logarithm; 0 up to that rate."""
    q = np.clip(q, 1e-9, 1 - 1e-9)
    f = np.clip(d / c, 1e-9, 1 - 1e-9)
    return np.where(d > q * c, d * np.log(f / q) + (c - d) * np.log((1 - f) / (1 - q)), 0.0)


def choose_pairs(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays: the terms of each pair that is toxic where both meet, however little either tells alone.

    All pairs of terms that occur in ``LEAST_PAIR`` toxic rows are counted. A
    pair counts if chance would give any pair so many toxic rows at most once in
    20 samples, and if they exceed by ``LEAST_CHI`` what the two terms give when
    their odds are multiplied, and what the more toxic one gives alone.
    """
    y = np.asarray(y) > 0
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, toxic = len(y), int(y.sum())
    if not 0 < toxic < n:
        return none
    rows = [rows[i] for i in np.argsort(~y, kind="stable")]
    df, dp = (np.bincount(np.concatenate(r), minlength=SLOTS) for r in (rows, rows[:toxic]))
    terms = np.flatnonzero(dp >= LEAST_PAIR)
    terms = terms[np.argsort(-dp[terms], kind="stable")]
    if len(terms) < 2:
        return none
    at = np.full(SLOTS, -1)
    at[terms] = np.arange(len(terms))
    bits = np.zeros((len(terms), (n + 7) // 8), np.uint8)
    for i, r in enumerate(rows):
        known = at[r]
        bits[known[known >= 0], i >> 3] |= 128 >> (i & 7)
    share, need = toxic / n, np.log(len(terms) * (len(terms) - 1) / 2) + np.log(20)
    rate = (dp[terms] + share) / (df[terms] + 1)
    odds = np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    starts = range(0, len(terms), PAIR_BLOCK)
    block = lambda k: np.unpackbits(bits[k : k + PAIR_BLOCK], axis=1, count=n).astype(np.float32)
    found = [none]
    for a in starts:
        left = block(a)
        for b in starts[a // PAIR_BLOCK :]:
            right = left if a == b else block(b)
            both = left[:, :toxic] @ right[:, :toxic].T
            enough = both * -np.log(share) >= need
            if a == b:
                enough = np.triu(enough, 1)
            if not enough.any():
                continue
            i, j = np.nonzero(enough)
            d = both[i, j].astype(np.float64)
            c = d + (left[:, toxic:] @ right[:, toxic:].T)[i, j]
            i, j = i + a, j + b
            sure = _excess(d, c, share) >= need
            i, j, d, c = i[sure], j[sure], d[sure], c[sure]
            alone = np.maximum(1 / (1 + np.exp(-odds[i] - odds[j]) * (1 - share) / share), np.maximum(rate[i], rate[j]))
            good = 2 * _excess(d, c, alone) >= LEAST_CHI
            found.append((terms[i[good]], terms[j[good]]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def train(rows: list[np.ndarray], y: np.ndarray, epochs: int = 30, rate: float = 0.1, l2: float = 5e-4, terms: int = TERMS, seed: int = 3) -> Machine:
    """AdaGrad on the logistic loss, over all rows.

    The threshold is the least score above which at most one row and 2 of 100
    are clean, each row scored by a model that didn't see its fold.
    Without rows of both classes nothing is ever rejected.
    """
    rng = np.random.default_rng(seed)
    own = distinct_rows(rows)
    rows, y = [rows[i] for i in own], np.asarray(y, np.float64)[own]
    if not len(y) or y.min() == y.max():
        return Machine(0.0, np.zeros(SLOTS, np.int32), np.zeros(1), np.zeros((1, FACTORS)), np.inf)
    fold = rng.permutation(len(y)) % FOLDS
    scores = np.zeros(len(y))
    for k in range(FOLDS):
        held = np.flatnonzero(fold == k)
        scores[held] = descend(rows, y, np.flatnonzero(fold != k), epochs, rate, l2, terms, rng).scores([rows[i] for i in held])
    out = descend(rows, y, np.arange(len(y)), epochs, rate, l2, terms, rng)
    out.threshold = pick_threshold(scores, y)
    return out


def descend(rows: list[np.ndarray], y: np.ndarray, fit: np.ndarray, epochs: int, rate: float, l2: float, terms: int, rng: np.random.Generator) -> Machine:
    """A machine trained on the rows ``fit``."""
    own = [rows[i] for i in fit]
    left, right = choose_pairs(own, y[fit])
    chosen = np.union1d(choose_terms(own, y[fit], terms), np.r_[left, right])
    index = np.zeros(SLOTS, np.int32)
    index[chosen] = np.arange(1, len(chosen) + 1)
    w, v = np.zeros(len(chosen) + 1), rng.normal(0, 0.05, (len(chosen) + 1, FACTORS))
    v[0] = 0
    share = y[fit].mean() if len(fit) else 0.0
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    gw, gv, gb = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    at = [index[rows[i]][index[rows[i]] > 0] for i in fit.tolist()]
    sizes = np.array([len(a) for a in at], np.int64)
    flat, begin, labels = np.concatenate([*at, np.zeros(0, np.int32)]), np.r_[0, np.cumsum(sizes)], y[fit]
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // 64)):
            if not len(batch):
                continue
            n, row = len(batch), np.repeat(np.arange(len(batch)), sizes[batch])
            first = np.cumsum(sizes[batch]) - sizes[batch]
            a = flat[np.arange(len(row)) - first[row] + begin[batch][row]]
            va = v[a]
            total = np.stack([np.bincount(row, va[:, f], n) for f in range(FACTORS)], 1)
            s = bias + np.bincount(row, w[a], n) + 0.5 * ((total * total).sum(1) - np.bincount(row, (va * va).sum(1), n))
            g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - labels[batch]
            dw = np.bincount(a, g[row], len(w))
            each = g[row, None] * (total[row] - va)
            dv = np.stack([np.bincount(a, each[:, f], len(w)) for f in range(FACTORS)], 1)
            dw, dv, db = dw / n + l2 * w, dv / n + l2 * v, g.sum() / n
            gw += dw * dw
            gv += dv * dv
            gb += db * db
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            bias -= rate * db / np.sqrt(gb)
        w[0], v[0] = 0, 0
    return Machine(float(bias), index, w, v)


def pick_threshold(scores: np.ndarray, y: np.ndarray, wrong: float = 0.02, floor: float = -1.5) -> float:
    """The least score, at least ``floor``, such that at most one row, and that share, of those above it are clean; halfway to the next row below."""
    order = np.argsort(-scores, kind="stable")
    clean = np.cumsum(1 - y[order])
    good = np.flatnonzero((clean <= 1 + wrong * np.arange(1, len(y) + 1)) & (y[order] == 1) & (scores[order] > floor))
    if not len(good):
        return max(floor, float(scores.max(initial=floor)))
    k = good[-1]
    below = scores[order[k + 1]] if k + 1 < len(order) else scores[order[k]]
    return max(floor, float((scores[order[k]] + below) / 2))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = tx.utf8(batch.column(1))
        out: list[bytes] = []
        for i, j in tx.slices(offs):
            out.extend(r.tobytes() for r in term_slots(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["doc_id", "slots", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Trains on the ``max_train`` labelled documents whose doc_id has the least hash; null labels don't count.

    Only this sample of (doc_id, toxic) is broadcast, and only its terms come to
    the driver.
    """
    p, q = Placed(docs, "doc_id", "text"), Placed(labels, "doc_id", "toxic")
    sample = q.only().where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = p.only().where("text is not null").join(F.broadcast(sample), F.col("doc_id").cast("long") == F.col("id")).select("id", "text", "toxic")
    got = texts.mapInArrow(_terms, "doc_id long, slots binary, toxic int").toArrow().sort_by([("doc_id", "ascending"), ("slots", "ascending")])
    rows = [np.frombuffer(x, np.int32) for x in got.column("slots").to_pylist()]
    return train(rows, got.column("toxic").to_numpy())


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Machine = shared.value
        for batch in batches:
            buf, offs = tx.utf8(batch.column(1))
            out: list[np.ndarray] = []
            for i, j in tx.slices(offs):
                part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                slot, first = slots_of(part, at)
                row = model.index[slot.ravel()]
                known = np.flatnonzero(row)
                cut = np.searchsorted(known, first * slot.shape[1])
                row = row[known]
                out.append(np.array([model._score(np.unique(row[a:b])) if b > a else model.bias for a, b in zip(cut[:-1], cut[1:], strict=True)]))
            score = np.concatenate(out) if out else np.zeros(0)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=null), pa.array((score > model.threshold) & ~null)], ["doc_id", "score", "toxic"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, score, toxic) for every document.

    A null text has a null score and is not toxic; an empty text has the bias as
    its score. Each row is scored for itself, so repeated rows give repeated
    results and a null doc_id stays null. An empty table gives no rows; without
    labels of both classes nothing is toxic. A document with several labels
    counts as toxic if any says so. Extra columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train))
    plain = Placed(docs, "doc_id", "text").only().select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(_score(shared), "doc_id long, score double, toxic boolean")


def _filter(shared, text_at: int):
    score = _score(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(text_at)], ["doc_id", "text"])
            toxic = next(score(iter([two]))).column(2)
            yield batch.filter(pc.invert(toxic))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that the model doesn't reject, in one pass and without a join."""
    p = Placed(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train))
    return p.restore(p.df.mapInArrow(_filter(shared, p.private.index(p["text"])), p.df.schema))
