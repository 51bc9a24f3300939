from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE, prose
from tidewater.llm import quality


def brute(trusted: list[str], order: int = 5):
    """log-probability per byte of a text under an interpolated modified Kneser-Ney model in plain dictionaries."""
    counts: list[dict] = [defaultdict(int) for _ in range(order + 1)]
    for t in trusted:
        b = bytes(order - 1) + t.encode()
        for k in range(order - 1, len(b)):
            counts[order][b[k - order + 1 : k + 1]] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    cut, total, freed = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
    for n in range(1, order + 1):
        m = [sum(c == k for c in counts[n].values()) for k in range(5)]
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else None
        d = [0.0, 0.5, 1.0, 1.5]
        for k in (1, 2, 3):
            if y is not None and m[k]:
                d[k] = max(0.0, min(float(k), k - (k + 1) * y * m[k + 1] / m[k]))
        cut[n] = d
        total[n], freed[n] = defaultdict(int), defaultdict(float)
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            freed[n][g[:-1]] += d[min(c, 3)]

    def p(g: bytes) -> float:
        n = len(g)
        below = p(g[1:]) if n > 1 else 1 / 256
        t = total[n].get(g[:-1], 0)
        if not t:
            return below
        c = counts[n].get(g, 0)
        return (c - (cut[n][min(c, 3)] if c else 0)) / t + freed[n][g[:-1]] / t * below

    def cost(text: str) -> float:
        b = bytes(order - 1) + text.encode()
        return -sum(math.log(p(b[k - order + 1 : k + 1])) for k in range(order - 1, len(b))) / (len(b) - order + 1)

    return cost


ROWS = [(k, prose(30 + k, 25 + k), "en" if k % 2 else "fr") for k in range(24)] + [(30, "zzzz qqqq xxxx", "en"), (31, "a", "fr"), (32, "", "en"), (33, None, "fr"), (34, prose(36, 31), "fr")]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, int(k < 20), 0, "x") for k in range(24)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (2, 1, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def hold(docs, trusted: set, got: list, langs, quantile=quality.QUANTILE):
    """The rows of ``classify`` against dictionaries: two models a language, each text under that of the other fold."""
    rows = docs.select("doc_id", "text", "lang", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for lang in langs:
        own = [r for r in rows if r.lang == lang]
        cost = {f: brute([r.text for r in own if r.doc_id in trusted and r.text and r.fold == 1 - f]) for f in (0, 1)}
        want = {r.doc_id: cost[r.fold](r.text) for r in own if r.text}
        bar = sorted(math.ceil(want[d] * quality.STEP) for d in want if d in trusted)
        bar = bar[math.ceil(len(bar) * quantile) - 1] / quality.STEP if bar else None
        for r in own:
            g = by[r.doc_id]
            if not r.text:
                assert g.perplexity is None and not g.keep
                continue
            assert g.perplexity == pytest.approx(math.exp(want[r.doc_id]), rel=1e-5), r.doc_id
            assert (g.threshold is None) == (bar is None)
            if bar is None:
                assert g.keep
            else:
                assert g.threshold == pytest.approx(math.exp(bar), rel=1e-3)
                if abs(want[r.doc_id] - bar) > 2 / quality.STEP:
                    assert g.keep == (want[r.doc_id] < bar), r.doc_id


@pytest.mark.parametrize("sizes", [{}, {"chunk": 5, "shard": 100, "asked": 30}])
def test_against_brute_force(documents, labels, sizes):
    """One chunk, shard and question table, and many small ones, give the brute-force perplexities."""
    got = quality.classify(documents(ROWS), labels, **sizes).collect()
    hold(documents(ROWS, clash=False), {k for k in range(20)}, got, ("en", "fr"))
    assert not next(r for r in got if r.doc_id == 30).keep


def test_a_whole_table_against_brute_force(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    got = quality.classify(docs, labels, chunk=64).collect()
    hold(docs, {r.doc_id for r in labels.where("quality = 1").collect()}, got, sorted({r.lang for r in got}))


def test_good_documents_are_kept_and_bad_ones_are_not(spark):
    """Trained on the labels of even doc_id, judged on the others."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    keep = {r.doc_id: r.keep for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([keep[r.doc_id] for r in held if r.quality == 1]) >= 0.98
    assert np.mean([keep[r.doc_id] for r in held if r.quality == 0]) <= 0.6


def test_keys_survive_packing():
    rng = np.random.default_rng(4)
    for keys in (np.zeros(0, np.int64), np.array([0]), np.unique(rng.integers(0, 1 << 62, 1000))):
        assert np.array_equal(quality.unpack_keys(quality.pack_keys(keys), len(keys)), keys)
        table = quality.Table(keys, np.arange(len(keys), dtype=np.float32))
        assert np.array_equal(table.get(keys[::-1]), np.arange(len(keys))[::-1])
    with pytest.raises(RuntimeError, match="changed"):
        table.get(np.array([5]))


def test_edges(edge, empty, labels):
    got = quality.classify(edge, labels.limit(0)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in EDGE)
    assert all(r.threshold is None and r.keep == (r.perplexity is not None) for r in got)
    assert quality.classify(empty, labels).count() == 0


def test_null_language(documents, labels):
    got = {r.doc_id: r for r in quality.classify(documents([(1, prose(60, 30), None), (29, prose(61, 30), "en")]), labels).collect()}
    assert got[1].lang is None and got[1].threshold is not None and got[1].keep
    assert got[29].threshold is None and got[29].keep
