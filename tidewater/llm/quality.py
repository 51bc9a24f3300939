"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of order 5 over UTF-8 bytes, each text preceded by 4 zero bytes.
Trusted texts are the documents labelled of good quality, all of them. Texts are
dealt into two folds by their hash, each language has a model of the trusted
texts of either fold, and every text, trusted or not, is scored by the model of
the other fold. So no text is judged by a model that saw it, and thresholds,
quantiles of the perplexities of all trusted texts of a language, hold for unseen text.

Documents are read twice and never shuffled. They fall into chunks by their
place in the files. The first pass reduces each chunk to its distinct 5-grams and
their counts in trusted text. Spark adds these up by 5-gram, and from that table
everything follows by sharded joins and windows keyed on contexts: counts of the
highest order, continuation counts of the lower ones, totals and discounts per
context, and the interpolated probability of every 5-gram. Each chunk's 5-grams
are then joined with the shards of that table, and the second pass reads the
answers to its chunks. This is the only way, whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import _text as tx
from tidewater.llm._frame import Placed, broadcast_if, discard, materialise, read_keyed, with_places, write_keyed

ORDER = 5
QUANTILE = 0.995
STEP = 1000  # thresholds are exact to 1 / STEP of log-perplexity
#: Rows of a file in a chunk; entries of the model in a shard; questions that one task answers.
CHUNK, SHARD, ASKED = 16384, 250_000, 4_000_000
_PAD = ORDER - 1
_SPREAD = 1_000_003


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted non-negative keys as compressed planes of the bytes of their differences."""
    planes = np.diff(keys, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64))


def grams(buf: np.ndarray, offs: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The packed 5-gram that ends in each byte, below the language's number."""
    n = len(offs) - 1
    padded = np.zeros(len(buf) + _PAD * n, np.uint8)
    sizes = np.diff(offs)
    at = np.arange(len(buf)) + np.repeat(_PAD * np.arange(1, n + 1), sizes)
    padded[at] = buf
    key = np.zeros(len(padded), np.int64)
    for k in range(ORDER):
        key[_PAD:] |= padded[k : len(padded) - _PAD + k].astype(np.int64) << (8 * (_PAD - k))
    return key[at] | np.repeat(lang.astype(np.int64), sizes) << (8 * ORDER)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    u, at = np.unique(k, return_inverse=True)
    return u, np.bincount(at, c, len(u)).astype(np.int64)


def _side(path: str, chunk: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language, and whether trusted, of rows of a chunk."""
    t = read_keyed(path, "chunk", chunk, ["row", "lang_no", "trusted"])
    own = t.column("row").to_numpy()
    order = np.argsort(own)
    at = order[np.searchsorted(own, rows, sorter=order)]
    return t.column("lang_no").to_numpy()[at], t.column("trusted").to_numpy()[at]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Parts of a batch by chunk."""
    chunks = np.array(batch.column(0).to_pylist(), object)
    cut = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]]) if len(chunks) else []
    for a, b in zip(cut, [*cut[1:], len(chunks)], strict=True):
        yield chunks[a], batch.slice(a, b - a)


class _Counts:
    """The distinct 5-grams of one chunk: those that its texts ask for, and those of trusted texts with counts."""

    def __init__(self) -> None:
        self.asked: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, asked: np.ndarray, trained: np.ndarray) -> None:
        u, n = np.unique(trained, return_counts=True)
        self.asked.append(np.unique(asked))
        self.keys.append(u)
        self.counts.append(n)
        self.held += len(u) + len(self.asked[-1])
        if self.held > 2_000_000:
            self.shrink()

    def shrink(self) -> None:
        self.asked = [np.unique(np.concatenate([np.zeros(0, np.int64), *self.asked]))]
        k, n = _merge(self.keys, self.counts)
        self.keys, self.counts, self.held = [k], [n], 0

    def row(self, chunk: str) -> pa.RecordBatch:
        self.shrink()
        (asked,), (keys,), (counts,) = self.asked, self.keys, self.counts
        full = [chunk, len(asked), pack_keys(asked), len(keys), pack_keys(keys), pa.compress(counts.astype("<i8").tobytes(), "zstd", asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(full, [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["chunk", "n_asked", "asked", "n_keys", "keys", "counts"])


GRAMS = "chunk string, n_asked long, asked binary, n_keys long, keys binary, counts binary"


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, _Counts()
        for whole in batches:
            for chunk, batch in _runs(whole):
                if chunk != now:
                    if now is not None:
                        yield own.row(now)
                    now, own = chunk, _Counts()
                lang, trusted = _side(path, chunk, batch.column(1).to_numpy())
                fold = batch.column(2).to_numpy()
                buf, offs = tx.utf8(batch.column(3))
                for i, j in tx.slices(offs):
                    at = offs[i : j + 1] - offs[i]
                    asked = grams(buf[offs[i] : offs[j]], at, 2 * lang[i:j] + 1 - fold[i:j])
                    # the model that a text trains differs from the one that it asks in the last bit of its number
                    own.add(asked, asked[np.repeat(trusted[i:j], np.diff(at))] ^ (1 << 8 * ORDER))
        if now is not None:
            yield own.row(now)

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the chunks of a task, added up; n is 0 for what is only asked for."""
    keys, counts, held = [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], ["key", "n"])

    for batch in batches:
        for r in batch.to_pylist():
            asked = unpack_keys(r["asked"], r["n_asked"])
            keys += [asked, unpack_keys(r["keys"], r["n_keys"])]
            counts += [np.zeros(len(asked), np.int64), np.frombuffer(pa.decompress(r["counts"], 8 * r["n_keys"], "zstd", asbytes=True), "<i8")]
            held += len(asked) + r["n_keys"]
            if held > 4_000_000:
                keys, counts = ([x] for x in _merge(keys, counts))
                held = len(keys[0])
                if held > 2_000_000:
                    yield out()
                    keys, counts, held = [], [], 0
    if keys:
        keys, counts = ([x] for x in _merge(keys, counts))
        yield out()


def _discount(k: int, d: Column) -> Column:
    """A discount within 0 and k; its usual size where counts of counts don't give one (``greatest`` and ``least`` skip nulls)."""
    return F.when(d.isNull(), k / 2).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(k)), d)))


def kneser_ney(table: DataFrame) -> DataFrame:
    """(key, logp) of every 5-gram of ``table`` (key, n: count in trusted text, 0 for those not in it).

    Interpolated modified Kneser-Ney: discounts D1, D2, D3+ by order and
    model from the counts of counts; lower orders count distinct left
    neighbours; below order 1 stands 1/256. Where counts of counts are too thin
    for a discount, 0.5, 1 and 1.5 take its place.
    """
    orders = {ORDER: table.select("key", F.col("n").alias("c"))}
    for order in range(ORDER - 1, 0, -1):
        wide = 8 * (order + 1)
        shorter = F.shiftleft(F.shiftright("key", wide), 8 * order).bitwiseOR(F.col("key").bitwiseAND((1 << 8 * order) - 1))
        longer = orders[order + 1].select(shorter.alias("key"), "c")
        orders[order] = materialise(longer.groupBy("key").agg(F.count_if(F.col("c") > 0).alias("c")), f"order{order}")
    below = None
    for order in range(1, ORDER + 1):
        rows = orders[order].withColumn("model", F.shiftright("key", 8 * order))
        n1, n2, n3, n4 = (F.count_if(F.col("c") == k).cast("double") for k in (1, 2, 3, 4))
        y = F.try_divide(n1, n1 + 2 * n2)
        d = rows.groupBy("model").agg(
            _discount(1, 1 - 2 * y * F.try_divide(n2, n1)).alias("d1"),
            _discount(2, 2 - 3 * y * F.try_divide(n3, n2)).alias("d2"),
            _discount(3, 3 - 4 * y * F.try_divide(n4, n3)).alias("d3"),
        )
        cut = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.join(broadcast_if(d, 10_000), "model").withColumn("cut", cut)
        context = Window.partitionBy(F.shiftright("key", 8))
        total, freed = F.sum("c").over(context), F.sum("cut").over(context)
        rows = rows.select("key", F.when(total > 0, (F.col("c") - F.col("cut")) / total).otherwise(0.0).alias("own"), F.when(total > 0, freed / total).otherwise(1.0).alias("gamma"))
        if below is None:
            rows = rows.select("key", (F.col("own") + F.col("gamma") / 256).alias("p"))
        else:
            wide = 8 * order
            suffix = F.shiftleft(F.shiftright("key", wide), wide - 8).bitwiseOR(F.col("key").bitwiseAND((1 << (wide - 8)) - 1))
            rows = rows.withColumn("suffix", suffix).join(below.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix").select("key", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
        done, below = below, materialise(rows.select("key", F.log("p").alias("logp")), "logp") if order == ORDER else materialise(rows, f"p{order}")
        discard(done)
        if order < ORDER:
            discard(orders[order])
    return below


class Table:
    """Look-up by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several keys for a slot the last one stays
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; a key that isn't there is an error."""
        slot = self.slot(keys)
        out = self.values[slot]
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            if (found == -1).any():
                raise RuntimeError("the documents changed between two reads")
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit]
        return out


def _ask(shards: int, salts: int):
    """Each chunk's questions by shard; a chunk goes to one of the copies of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, asked in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n_asked", "asked")), strict=True):
                keys = unpack_keys(asked, n)
                shard = keys % _SPREAD % shards
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
                parts = np.split(keys[order], cut[1:]) if n else []
                salt = int(tx.mix(np.frombuffer(chunk.encode().ljust(64), np.uint64)).sum() % np.uint64(salts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[order][cut], pa.int64()), pa.array([salt] * len(parts), pa.int64()), pa.array([chunk] * len(parts), pa.string()), pa.array([len(x) for x in parts], pa.int64()), pa.array([pack_keys(x) for x in parts], pa.binary())],
                    ["shard", "salt", "chunk", "n", "keys"],
                )

    return run


def _answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
    keys, logp = shard.column("key").to_numpy(), shard.column("logp").to_numpy().astype("<f4")
    order = np.argsort(keys)
    keys, logp = keys[order], logp[order]
    out = []
    for raw, n in zip(asked.column("keys").to_pylist(), asked.column("n").to_pylist(), strict=True):
        out.append(logp[np.searchsorted(keys, unpack_keys(raw, n))].tobytes())
    return pa.table({"chunk": asked.column("chunk"), "n": asked.column("n"), "keys": asked.column("keys"), "logp": pa.array(out, pa.binary())})


def _score(side: str, answers: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for whole in batches:
            for chunk, batch in _runs(whole):
                if chunk != now:
                    got = read_keyed(answers, "chunk", chunk)
                    parts = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] if got is None else [(unpack_keys(r["keys"], r["n"]), np.frombuffer(r["logp"], "<f4")) for r in got.to_pylist()]
                    # tasks that share a chunk may have asked the same
                    keys, first = np.unique(np.concatenate([k for k, _ in parts]), return_index=True)
                    now, table = chunk, Table(keys, np.concatenate([v for _, v in parts])[first])
                lang, trusted = _side(side, chunk, batch.column(1).to_numpy())
                fold = batch.column(2).to_numpy()
                buf, offs = tx.utf8(batch.column(3))
                out = [np.zeros(0)]
                for i, j in tx.slices(offs, 1 << 20):
                    at = offs[i : j + 1] - offs[i]
                    logp = table.get(grams(buf[offs[i] : offs[j]], at, 2 * lang[i:j] + 1 - fold[i:j]))
                    total = np.r_[0.0, np.cumsum(logp, dtype=np.float64)]
                    size = np.diff(at)
                    out.append(np.where(size > 0, (total[at[:-1]] - total[at[1:]]) / np.maximum(size, 1), np.nan))
                value = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), pa.array(trusted), pa.array(value, mask=np.isnan(value))], ["doc_id", "lang", "trusted", "cost"])

    return run


def costs(docs: DataFrame, labels: DataFrame, chunk: int = CHUNK, shard: int = SHARD, asked: int = ASKED) -> DataFrame:
    """(doc_id, lang, trusted, cost): negative log-probability per byte under the model of the text's language and the other fold."""
    q = Placed(labels, "doc_id", "quality")
    rows = with_places(docs, "doc_id", "text", "lang").select(
        F.concat(F.hex(F.xxhash64("file")), F.lit("-"), F.floor(F.col("row") / chunk).cast("string")).alias("chunk"), "row", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold"), "text", F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
    )
    # what a text trains or asks depends on joins of ids alone, which lie beside the chunks
    ids = rows.select("chunk", "row", "doc_id", "lang")
    langs = materialise(ids.select(F.col("lang").alias("l")).distinct(), "langs")
    if langs.count() >= 1 << 22:
        raise ValueError("more than 4 million languages")
    numbers = langs.select("l", (F.row_number().over(Window.orderBy("l")) - 1).cast("long").alias("lang_no"))
    good = q.only().where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good")).distinct()
    side = write_keyed(ids.join(broadcast_if(numbers, 10_000), F.col("lang").eqNullSafe(F.col("l"))).join(good, F.col("doc_id") == F.col("good"), "left").select("chunk", "row", "lang_no", F.col("good").isNotNull().alias("trusted")), "chunk", "side")
    found = materialise(rows.where("length(text) > 0").select("chunk", "row", "fold", "text").mapInArrow(_count(side), GRAMS), "grams")
    table = materialise(found.mapInArrow(_entries, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "entries")
    logp = kneser_ney(table)
    discard(table)
    shards = max(1, -(-logp.count() // shard))
    salts = max(1, -(-(found.agg(F.sum("n_asked")).first()[0] or 0) // (shards * asked)))
    questions = found.select("chunk", "n_asked", "asked").mapInArrow(_ask(shards, salts), "shard long, salt long, chunk string, n long, keys binary")
    copies = logp.select("key", "logp", (F.col("key") % _SPREAD % shards).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    answers = write_keyed(questions.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_answer, "chunk string, n long, keys binary, logp binary"), "chunk", "answers")
    discard(found)
    discard(logp)
    scored = materialise(rows.mapInArrow(_score(side, answers), "doc_id long, lang string, trusted boolean, cost double"), "costs")
    discard(None, side, answers)
    return scored


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, **sizes: int) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) of every document.

    ``perplexity``, per byte, is that under the model of the other fold's trusted
    texts. ``threshold`` is the ``quantile`` of the perplexities of the
    language's trusted documents; documents above it aren't kept. A language
    without trusted documents has a null threshold and all its documents are
    kept; a model without a text gives every byte 1/256. Null and empty texts
    have a null perplexity and aren't kept. A null lang is a language of its
    own. Equal texts are in one fold; repeated rows give repeated results.
    Without labels nothing is trusted and everything with text is kept. An
    empty table gives no rows. Extra columns are not looked at.
    """
    scored = costs(docs, labels, **sizes).withColumn("bin", F.ceil(F.col("cost") * STEP))
    bins = scored.where("trusted and bin is not null").groupBy("lang", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    cut = bins.select("lang", "bin", F.sum("n").over(by.orderBy("bin")).alias("up"), F.sum("n").over(by).alias("total")).where(F.col("up") >= F.col("total") * quantile).groupBy(F.col("lang").alias("l")).agg(F.min("bin").alias("cut"))
    out = scored.join(broadcast_if(cut, 10_000), F.col("lang").eqNullSafe(F.col("l")), "left")
    keep = F.col("bin").isNotNull() & (F.col("cut").isNull() | (F.col("bin") <= F.col("cut")))
    return out.select("doc_id", "lang", F.exp("cost").alias("perplexity"), F.exp(F.col("cut") / STEP).alias("threshold"), keep.alias("keep"))
