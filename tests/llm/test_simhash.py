from __future__ import annotations

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidewater.llm import _text as tx
from tidewater.llm import simhash


def brute(prints: list[tuple[int, bytes]], most: int) -> dict[int, int]:
    """Node -> least node of its component, roots left out, from all pairs."""
    root: dict[int, int] = {i: i for i, _ in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    words = np.frombuffer(b"".join(f for _, f in prints), np.uint64).reshape(-1, simhash.WORDS)
    for k in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(words[k + 1 :] ^ words[k]).sum(1) <= most) + k + 1
        for j in near.tolist():
            a, b = find(prints[k][0]), find(prints[j][0])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root if find(i) != i}


def test_fingerprint_is_the_sign_of_summed_bits():
    features = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x1234567)
    spread = tx.mix(features[:, None] ^ simhash._SALTS[None, :]).view(np.uint8).reshape(len(features), -1)
    ones = np.unpackbits(spread, axis=1).sum(0)
    assert simhash.fingerprint(features) == np.packbits(ones * 2 > len(features)).tobytes()


def test_against_all_pairs(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    prints = sorted((r.id, bytes(r.fp)) for r in simhash.fingerprints(docs).collect())
    want = brute(prints, 120)
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_copies(docs).collect()}
    assert want
    assert set(got) <= set(want)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want)


@pytest.mark.parametrize("n", [1, 400_000, 1_000_000, 30_000_000])
def test_recall_of_the_recursion(n):
    """Pairs at the greatest distance that counts meet in a list in 9 of 10 cases, whatever the weights and the depth."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2, (400, simhash.BITS), dtype=np.uint8)
    b = a.copy()
    for row in b:
        row[rng.choice(simhash.BITS, 120, replace=False)] ^= 1
    levels = simhash.levels_for(n, 4096, 120, 0.9)
    rows, keys = simhash.lists_of(np.concatenate([a, b]), levels, 7)
    left = set(zip(rows[rows < 400].tolist(), keys[rows < 400].tolist(), strict=True))
    met = {r - 400 for r, k in zip(rows[rows >= 400].tolist(), keys[rows >= 400].tolist(), strict=True) if (r - 400, k) in left}
    assert len(met) >= 340, levels
    want = np.prod([simhash.share(low) * strips * simhash.SHIFTS for low, strips in levels])
    assert 0.8 * want < len(rows) / 800 < 1.2 * want


def test_a_group_of_many_copies_and_a_chain(documents):
    text = prose(9, 200)
    words = text.split()
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(0, 200, 10)]
    docs = documents([(100 + i, text) for i in range(50)] + [(200 + i, t) for i, t in enumerate(near)] + [(1, prose(10, 200))])
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_copies(docs).collect()}
    assert set(got) == {*range(101, 150), *range(200, 220)}
    assert set(got.values()) == {100}


def test_edges(edge, empty):
    got = {(r.doc_id, r.kept_doc_id) for r in simhash.near_copies(edge).collect()}
    assert got == {(6, 5), (10, 9)}
    kept = simhash.drop_near_copies(edge)
    assert kept.columns == edge.columns
    ids = [r[0] for r in kept.collect()]
    assert sorted(str(i) for i in ids) == sorted(map(str, [None, None, 1, 2, 3, 4, 5, 5, 7, 7, 8, 9]))
    assert simhash.near_copies(empty).count() == 0
    assert simhash.drop_near_copies(empty).columns == empty.columns
