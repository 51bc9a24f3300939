from __future__ import annotations

import numpy as np

from tests.llm.conftest import EDGE
from tidewater.llm import toxicity


def test_score_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(0.3, np.arange(toxicity.SLOTS, dtype=np.int32), rng.normal(size=20), rng.normal(size=(20, 4)))
    row = np.array([3, 7, 11, 19])
    want = 0.3 + m.w[row].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(row) for b in row[i + 1 :])
    assert abs(m.scores([row])[0] - want) < 1e-9


def test_learns_an_interaction():
    """Toxic where exactly two terms meet; either one alone is clean, so no additive weights would do."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(1600):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.r_[rng.integers(100, 200_000, 30), [1] * int(a), [2] * int(b)].astype(np.int64)))
        y.append(int(a and b))
    m = toxicity.train(rows[:1200], np.array(y[:1200]), epochs=40)
    got = m.scores(rows[1200:]) > m.threshold
    assert (got == np.array(y[1200:], bool)).mean() > 0.97
    pair = m.v[m.index[1]] @ m.v[m.index[2]]
    assert pair > 0.5


def rare_pair(seed: int, n: int):
    """Rows of which 11 % are toxic for terms of their own, and those where terms 1 (8 %) and 2 (5 %) meet; which rows only the pair makes toxic."""
    rng = np.random.default_rng(seed)
    rows, y, pair = [], [], []
    for _ in range(n):
        other, a, b = rng.random() < 0.11, rng.random() < 0.08, rng.random() < 0.05
        rows.append(np.unique(np.r_[rng.integers(1000, 3000, 20), rng.integers(3000, 200_000, 30), rng.integers(10, 40, 3 * other), [1] * a, [2] * b].astype(np.int64)))
        y.append(int(other or (a and b)))
        pair.append(a and b and not other)
    return rows, np.array(y), np.array(pair, bool)


def test_a_pair_counts_though_its_terms_alone_do_not():
    for seed in range(3):
        rows, y, _ = rare_pair(seed, 4000)
        assert not {1, 2} <= set(toxicity.choose_terms(rows, y, toxicity.TERMS).tolist())
        left, right = toxicity.choose_pairs(rows, y)
        assert {frozenset(p) for p in zip(left.tolist(), right.tolist())} == {frozenset((1, 2))}
        m = toxicity.train(rows, y)
        held, label, pair = rare_pair(100 + seed, 4000)
        got = m.scores(held) > m.threshold
        assert pair.any() and got[pair].mean() >= 0.9 and got[label == 0].mean() <= 0.005


def test_pairs_of_every_block_are_counted(monkeypatch):
    rows, y, _ = rare_pair(5, 3000)
    want = {frozenset(p) for p in zip(*(x.tolist() for x in toxicity.choose_pairs(rows, y)), strict=True)}
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 7)
    assert {frozenset(p) for p in zip(*(x.tolist() for x in toxicity.choose_pairs(rows, y)), strict=True)} == want == {frozenset((1, 2))}
    assert not len(toxicity.choose_pairs(rows, np.zeros(3000))[0]) and not len(toxicity.choose_pairs([], np.zeros(0))[0])


def test_held_out_accuracy(spark):
    """Trained on the even labelled documents, judged on the odd ones."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = {r.doc_id: r.toxic for r in toxicity.score_documents(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    bad = [got[r.doc_id] for r in held if r.toxic == 1]
    good = [got[r.doc_id] for r in held if r.toxic == 0]
    assert np.mean(bad) >= 0.85 and np.mean(good) <= 0.005


def test_edges(spark, edge, empty):
    shape = "doc_id long, toxic int, text string"
    labels = spark.createDataFrame([(5, 1, "x"), (6, None, "x"), (None, 1, "x"), (7, 0, "x")], shape)
    for some in (labels, labels.limit(0)):
        got = toxicity.score_documents(edge, some).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in EDGE)
        assert all((r.score is None) == (r.doc_id == 1 or (r.doc_id is None and r.score is None)) for r in got)
        assert not any(r.toxic for r in got if r.score is None)
        kept = toxicity.drop_toxic(edge, some)
        assert kept.columns == edge.columns
    assert kept.count() == len(EDGE)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.drop_toxic(empty, labels).count() == 0
