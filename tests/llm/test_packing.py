from __future__ import annotations

import itertools

import numpy as np
import pytest

from tests.llm.conftest import EDGE
from tidewater.llm import packing


def plain_difference(sizes, k):
    """Karmarkar-Karp with sorted lists of (load, members), written the long way."""
    parts = []
    for n, i in enumerate(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))):
        parts.append((-sizes[i], n, [(sizes[i], [i])] + [(0, [])] * (k - 1)))
    n = len(parts)
    while len(parts) > 1:
        parts.sort()
        (_, _, a), (_, _, b) = parts.pop(0), parts.pop(0)
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda t: -t[0])
        parts.append((-(merged[0][0] - merged[-1][0]), n, merged))
        n += 1
    return sorted(x for x, _ in parts[0][2])


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_differencing(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        sizes = rng.integers(1, 100, 25)
        sets = packing.difference(sizes, k)
        assert sorted(itertools.chain(*sets)) == list(range(25))
        loads = sorted(int(sizes[s].sum()) for s in sets)
        assert loads == [x for x in plain_difference(sizes.tolist(), k) if x]


def test_beats_the_usual_bounds_and_raises_the_count():
    sizes = np.array([8, 7, 6, 5, 4])
    assert sorted(int(sizes[s].sum()) for s in packing.difference(sizes, 2)) == [14, 16]
    assert len(packing.pack(np.array([6, 6, 6]), 10)) == 3
    sets = packing.pack(np.full(100, 41), 100)
    assert len(sets) == 50 and all(len(s) == 2 for s in sets)


def check(docs, capacity, group):
    got = packing.pack_windows(docs, capacity, group).collect()
    seen = {}
    for w in got:
        assert w.n_tokens == sum(w.lengths) <= capacity
        assert len(w.doc_ids) == len(w.start_tokens) == len(w.lengths)
        for d, s, n in zip(w.doc_ids, w.start_tokens, w.lengths, strict=True):
            seen.setdefault(str(d), []).append((s, n))
    return got, seen


def test_every_token_once(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got, seen = check(docs, 4096, 512)
    for r in docs.collect():
        n = len([x for x in r.text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x])
        spans = sorted(seen.get(str(r.doc_id), []))
        assert sum(n for _, n in spans) == n and [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()][: len(spans)]
    loads = sorted(w.n_tokens for w in got)
    assert max(loads) - min(loads) <= 0.1 * 4096


def test_edges(edge, empty):
    _, seen = check(edge, 1000, 4)
    assert set(seen) == {str(i) for i, t in EDGE if t and t.strip()}
    assert sum(n for _, n in seen["4"]) == 40_000
    assert len(seen["5"]) == 2 and len(seen["7"]) == 2
    assert packing.pack_windows(empty).count() == 0
