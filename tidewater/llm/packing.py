"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Documents are spread over groups by the hash of their key, and each group is
packed by itself, so no task sees more than a group. Texts longer than a window
are cut into full windows and a last piece. In a group, every piece begins as a
partial partition that holds it alone in one of k windows; the two partitions
of greatest imbalance are merged, the fullest windows of one with the emptiest
of the other, until one partition is left. If its fullest window exceeds the
capacity, k rises by one and the group is packed anew.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._frame import Placed, materialise

CAPACITY = 4096
GROUP = 512


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in k sets of near-equal sums."""
    heap: list[tuple] = []
    for n, i in enumerate(np.argsort(-sizes, kind="stable")):
        load = np.zeros(k, np.int64)
        load[0] = sizes[i]
        heap.append((-int(sizes[i]), n, load, [[int(i)]]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, mine = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        # loads fall; only the first windows have members, the others are empty
        merged = a + b[::-1]
        sets = mine + [[] for _ in range(k - len(mine))]
        for j, members in enumerate(other):
            at = k - 1 - j
            sets[at] = sets[at] + members if sets[at] else members
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        used = k if merged[-1] else int(np.searchsorted(-merged, 0, "left"))
        n += 1
        sets = [sets[o] for o in order.tolist()]
        while len(sets) > used and not sets[-1]:
            sets.pop()
        heapq.heappush(heap, (-int(merged[0] - merged[-1]), n, merged, sets))
    if not heap:
        return []
    sets = heap[0][3]
    return [s for s in sets if s]


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; as few as differencing finds, from the sum's lower bound upwards."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sets = difference(sizes, k)
        if all(int(sizes[s].sum()) <= capacity for s in sets):
            return sets
        k += 1


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        part = group.sort_by([(c, "ascending") for c in ("doc_id", "start_token", "n_tokens")])
        sizes = part.column("n_tokens").to_numpy()
        sets = pack(sizes, capacity)
        first = part.column("group")[0].as_py() if len(part) else 0
        ids, starts = part.column("doc_id").to_pylist(), part.column("start_token").to_pylist()
        return pa.table(
            {
                "window_group": pa.array([first] * len(sets), pa.int64()),
                "window": pa.array(range(len(sets)), pa.int32()),
                "n_tokens": pa.array([int(sizes[s].sum()) for s in sets], pa.int64()),
                "doc_ids": pa.array([[ids[i] for i in sorted(s)] for s in sets], pa.list_(pa.int64())),
                "start_tokens": pa.array([[starts[i] for i in sorted(s)] for s in sets], pa.list_(pa.int64())),
                "lengths": pa.array([[int(sizes[i]) for i in sorted(s)] for s in sets], pa.list_(pa.int64())),
            }
        )

    return run


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): maximal runs of bytes other than ASCII white space."""
    plain = Placed(docs, "doc_id", "text").only().where("text is not null")
    return plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("n_tokens"))


def pack_windows(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(window_group, window, n_tokens, doc_ids, start_tokens, lengths): every token of every document in one window.

    The three lists run in parallel: which document, from which token, how many
    tokens. Null texts and texts without a token are in no window; rows without
    an id are packed like others, with a null in ``doc_ids``; repeated rows are
    packed as often as they occur. An empty table gives no windows. Extra
    columns are not looked at. No window exceeds ``capacity``.
    """
    counts = materialise(token_counts(docs).where("n_tokens > 0"), "counts")
    groups = max(1, -(-counts.count() // group))
    pieces = counts.select(
        F.pmod(F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id()), F.lit(groups)).alias("group"),
        "doc_id",
        "n_tokens",
        F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(capacity))).alias("start_token"),
    ).withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("start_token"), F.lit(capacity)))
    shape = "window_group long, window int, n_tokens long, doc_ids array<long>, start_tokens array<long>, lengths array<long>"
    return pieces.groupBy("group").applyInArrow(_pack(capacity), shape)
