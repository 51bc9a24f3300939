from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import embeddings
from tidewater.llm.graph import least_labels


def brute(rows, threshold):
    """id -> (class, links) from all pairs."""
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[n + 1 :]:
            if float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in root}


def test_error_bound_is_never_exceeded():
    rng = np.random.default_rng(0)
    for dim in (3, 64, 300):
        x = embeddings.unit(list(rng.normal(size=(60, dim)) * rng.choice([1, 1e-3, 1e3], dim)))
        q, scale, err = embeddings.quantise(x)
        approx = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale[None]
        norm = np.linalg.norm(q.astype(float), axis=1) * scale
        assert (np.abs(x @ x.T - approx) <= err[None] + err[:, None] * norm[None] + 1e-9).all()


@pytest.mark.parametrize(("tile", "pivots"), [(None, None), (20, 7), (8, 1)])
def test_against_all_pairs(spark, tile, pivots):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([centres[k % 12] + rng.normal(size=24) * rng.choice([0.05, 0.3, 1.0]) for k in range(150)]).reshape(150, 24).astype(np.float32)
    x[140:] = x[3]  # a group of equal vectors
    rows = [(int(i), v.astype(float)) for i, v in zip(rng.permutation(500)[:150], x, strict=True)]
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in rows], "vec_id long, embedding array<float>, codes string, cell int").repartition(3)
    for threshold in (0.5, 0.9, 0.999):
        got = {r.vec_id: (r.class_id, r.links) for r in embeddings.near_vectors(df, threshold, tile, pivots).collect()}
        assert got == brute(rows, threshold)


def _tile(x, first):
    q, scale, err = embeddings.quantise(embeddings.unit(x))
    n = len(x)
    return embeddings.Tile(pa.table({"vec_id": np.arange(first, first + n), "weight": np.ones(n, np.int64), "codes": [c.tobytes() for c in q], "scale": scale, "err": err, "vector": [v.tobytes() for v in x]}))


def test_blocks_of_a_dense_group():
    """More rows than a block, all near one another but not equal: links are counted, edges stay linear, and only open pairs are recomputed."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=32)
    x = (centre + 0.05 * rng.normal(size=(2500, 32))).astype(np.float32)
    a, b = _tile(x[:1500], 0), _tile(x[1500:], 1500)
    for threshold in (0.9, 0.998):
        u = embeddings.unit(x)
        want = (u @ u.T >= threshold).sum(1) - 1
        own_a, own_b = embeddings.tile_links(a, a, threshold, True), embeddings.tile_links(b, b, threshold, True)
        links, root, at = embeddings.tile_links(a, b, threshold, False)
        assert np.array_equal(links + np.r_[own_a[0], own_b[0]], want)
        assert len(at) < 2500 and (threshold > 0.9 or (root == 0).all())
    linked, again = embeddings.block_links(a, slice(0, 1024), b, slice(0, 1000), 0.9)
    assert linked.all() and again == 0


def test_block_stars_join_what_the_links_join():
    rng = np.random.default_rng(3)
    for density in (0.0, 0.004, 0.02, 0.2, 1.0):
        linked = rng.random((70, 90)) < density
        i, j = embeddings.block_stars(linked)
        x, y = np.nonzero(linked)
        assert np.array_equal(least_labels(160, i, j + 70), least_labels(160, x, y + 70)) and len(i) <= 160


def test_edges(spark):
    shape = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (None, [1.0, 0.0], 0), (7, [1.0, 0.0, 0.0], 0), (8, [float("nan"), 1.0], 0), (9, [1e30, 0.0], 0), (10, [-1.0, 0.0], 0), (11, [1.0, -0.0], 0)]
    got = {r.vec_id: (r.class_id, r.links) for r in embeddings.near_vectors(spark.createDataFrame(rows, shape), 0.9).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 9: (1, 3), 11: (1, 3), 7: (7, 0), 10: (10, 0)} | dict.fromkeys((3, 4, 5, 6, 8), (None, 0))
    assert embeddings.near_vectors(spark.createDataFrame([], shape), 0.9).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        embeddings.near_vectors(spark.createDataFrame(rows, shape), 0.0)
