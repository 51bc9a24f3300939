"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Each vector is scaled to unit length and quantised to int8 codes q with one
scale s: x = s q + e, and ||e|| is measured, not assumed. For two vectors

    |x.y - s_x s_y q_x.q_y| <= ||x|| ||e_y|| + ||e_x|| ||s_y q_y||

by Cauchy and Schwarz. A tile product gives all s_x s_y q_x.q_y of two blocks at
once, in float32, whose rounding, at most (dim + 4) 2**-24 for unit vectors, is
part of the bound. Pairs that the bound leaves open are recomputed in full
precision, and no others.

Equal vectors are one class from the start, and only its least id is multiplied.
Vectors lie in cells around pivots, cells are cut into tiles, and tiles are files
in the shared folder: a task reads the two tiles of each of its pairs, so vectors
are not copied for every pair. Angles obey the triangle inequality, so two cells
whose pivots are further apart than the threshold angle plus both radii hold no
pair, and their tiles are never multiplied. A task counts links and keeps a
spanning star for each component of its block; pairs are never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._frame import Placed, discard, materialise, read_keyed, write_keyed
from tidewater.llm.graph import components, least_labels

TILES = (1024, 65536)
#: Bytes of a tile's codes and vectors, at most.
TILE_BYTES = 64 << 20
PIVOTS = 2048
SLACK = 1e-6
OPEN = 1 << 18
CODES = "vec_id long, weight long, codes binary, scale double, err double, vector binary, dim int, cell int, angle double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and measured error norms (rounded up) of unit vectors."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    err = np.linalg.norm(x - scale[:, None] * q, axis=1)
    return q, scale, err * (1 + 1e-9) + 1e-12


def unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that hold a usable vector, and the vectors: not null, no null or non-finite part, not all zero."""
    rows, out = [], []
    for i, v in enumerate(column):
        if v.is_valid:
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            if len(x) and np.isfinite(x).all() and x.any():
                rows.append(i)
                out.append(x)
    return np.array(rows, int), out


def _encode(pivots: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = _vectors(batch.column(2))
            sizes = np.array([len(v) for v in vectors], int)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                x = unit([vectors[i] for i in mine])
                q, scale, err = quantise(x)
                own = [p for p in pivots if len(p) == dim]
                cos = x @ np.stack(own).T if own else np.ones((len(x), 1))
                cell = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(x)), cell], -1, 1))
                at = pa.array(rows[mine])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([c.tobytes() for c in q], pa.binary()), pa.array(scale), pa.array(err), pa.array([_exact(vectors[i]) for i in mine], pa.binary()), pa.array(np.full(len(x), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(angle)],
                    ["vec_id", "weight", "codes", "scale", "err", "vector", "dim", "cell", "angle"],
                )

    return run


def _exact(x: np.ndarray) -> bytes:
    """Single precision where it holds all of the vector, else double."""
    short = x.astype(np.float32)
    return (short if np.array_equal(short, x) else x).tobytes()


def _inexact(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64).astype(np.float64)


class Tile:
    """The vectors of one tile, by ascending id."""

    def __init__(self, table: pa.Table):
        self.id = table.column("vec_id").to_numpy()
        order = np.argsort(self.id, kind="stable")
        self.id = self.id[order]
        self.weight = table.column("weight").to_numpy()[order].astype(np.float64)
        self.scale, self.err = table.column("scale").to_numpy()[order], table.column("err").to_numpy()[order]
        self.q = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(len(order), -1)[order]
        self.x = (self.q * self.scale[:, None]).astype(np.float32)
        self.norm = np.linalg.norm(self.x.astype(np.float64), axis=1) + 1e-6
        raw = table.column("vector").to_pylist()
        self.raw = [raw[k] for k in order.tolist()]

    def exact(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([_inexact(self.raw[k], self.q.shape[1]) for k in rows.tolist()])


def similar(a: Tile, i: np.ndarray, b: Tile, j: np.ndarray) -> np.ndarray:
    """Similarities in double precision of the rows i of a and j of b."""
    out = np.zeros(len(i))
    for c in range(0, len(i), OPEN // 8):
        d = slice(c, c + OPEN // 8)
        ui, at_i = np.unique(i[d], return_inverse=True)
        uj, at_j = np.unique(j[d], return_inverse=True)
        out[d] = np.einsum("ij,ij->i", unit(a.exact(ui))[at_i], unit(b.exact(uj))[at_j])
    return out


def block_links(a: Tile, r: slice, b: Tile, c: slice, threshold: float) -> tuple[np.ndarray, int]:
    """Which pairs of the rows r of a and c of b reach the threshold, and how many were recomputed."""
    dot = a.x[r] @ b.x[c].T
    slack = SLACK + 1.02 * (a.x.shape[1] + 4) * 2.0**-24
    left, right = a.err[r] * b.norm[c].max(initial=0.0), b.err[c]
    if not dot.size or dot.max() + left.max() + right.max() + slack < threshold:
        return np.zeros(dot.shape, bool), 0
    sure = dot - right[None, :].astype(np.float32) >= (threshold + slack + left).astype(np.float32)[:, None]
    i, j = np.nonzero((dot + right[None, :].astype(np.float32) >= (threshold - slack - left).astype(np.float32)[:, None]) & ~sure)
    if len(i):
        sure[i, j] = similar(a, i + r.start, b, j + c.start) >= threshold
    return sure, len(i)


def block_stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) edges of a block that join the same rows and columns as all its links, at most one for each of them."""
    far = np.iinfo(np.int32).max
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    part = linked[np.ix_(rows, columns)]
    if part.sum() <= len(rows) + len(columns):
        i, j = np.nonzero(part)
        return rows[i], columns[j]
    label = np.arange(len(rows), dtype=np.int32)
    while True:
        down = np.where(part, label[:, None], far).min(0)
        up = np.where(part, down[None, :], far).min(1)
        if np.array_equal(up, label):
            break
        label = up
    # every label is that of a row of its component; rows reach it by the component's first column
    _, first = np.unique(down, return_index=True)
    hub = dict(zip(down[first].tolist(), first.tolist(), strict=True))
    at = np.array([hub[x] for x in label.tolist()])
    return np.r_[rows, rows[down]], np.r_[columns[at], columns]


def tile_links(a: Tile, b: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted links of the ids of a, then of b, and star edges (of places in a, then b) of their components."""
    n = len(a.id)
    links = np.zeros(n + (0 if same else len(b.id)))
    shift = 0 if same else n
    u, v = [np.zeros(0, int)], [np.zeros(0, int)]
    for lo in range(0, n, 1024):
        r = slice(lo, min(lo + 1024, n))
        for c0 in range(lo if same else 0, len(b.id), 2048):
            c = slice(c0, min(c0 + 2048, len(b.id)))
            linked, _ = block_links(a, r, b, c, threshold)
            if same:
                linked &= np.arange(c.start, c.stop)[None, :] > np.arange(r.start, r.stop)[:, None]
            if not linked.any():
                continue
            links[r] += linked @ b.weight[c]
            links[shift + c.start : shift + c.stop] += a.weight[r] @ linked
            i, j = block_stars(linked)
            u.append(i + r.start)
            v.append(j + c.start + shift)
    root = least_labels(len(links), np.concatenate(u), np.concatenate(v))
    return links, root, np.flatnonzero(root != np.arange(len(root)))


def _product(path: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Tile] = {}
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = {k: held[k] if k in held else Tile(read_keyed(path, "tile", k, ["vec_id", "weight", "codes", "scale", "err", "vector"])) for k in {left, right}}
                a, b, same = held[left], held[right], left == right
                links, root, at = tile_links(a, b, threshold, same)
                ids = a.id if same else np.r_[a.id, b.id]
                some = np.flatnonzero(links)
                none = pa.nulls(len(some) + len(at), pa.int64())
                # the root of a star is its least place, not its least id; components() orders the ends
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[ids[some], ids[at]]), pa.concat_arrays([none[: len(some)], pa.array(ids[root[at]])]), pa.concat_arrays([pa.array(links[some].astype(np.int64)), none[: len(at)]])],
                    ["u", "v", "links"],
                )

    return run


def _partners(cells: dict[int, tuple], reach: float):
    """For each cell, the tile pairs with itself and with later cells that may hold a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, cell, parts, radius in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = [(cell, parts)]
                if dim in cells:
                    centres, at, sizes, radii = cells[dim]
                    gap = np.arccos(np.clip(centres[at] @ centres[cell], -1, 1))
                    near += [(int(at[k]), int(sizes[k])) for k in np.flatnonzero((at > cell) & (gap <= radius + radii + reach))]
                for other, count in near:
                    left, right = np.triu_indices(parts) if other == cell else (x.ravel() for x in np.indices((parts, count)))
                    for k in range(0, len(left), 65536):
                        yield pa.RecordBatch.from_arrays([pa.array([f"{dim}-{cell}-{p}" for p in left[k : k + 65536]]), pa.array([f"{dim}-{other}-{p}" for p in right[k : k + 65536]])], ["a", "b"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, tile: int | None = None, pivots: int | None = None) -> DataFrame:
    """(vec_id, class_id, links) of every vector: how many others have a cosine similarity of at least ``threshold`` to it, exactly, and its class.

    Classes are the connected components of such pairs; ``class_id`` is the least
    id of one, a vector without links is its own class. The size of a tile follows
    from the number n of vectors: n / 16 within ``TILES`` and ``TILE_BYTES``; there
    is a pivot for each tile, ``PIVOTS`` at most. Where the pivots exclude nothing
    the work is quadratic, as it must be for an exact result. Vectors that are
    null, empty, all zero or hold a null or non-finite part have no class (null)
    and no links; rows without an id are left out; vectors of different lengths
    aren't compared. Of rows that share an id, the one of least content stands
    for all. An empty table gives no rows. Extra columns are not looked at.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    plain = Placed(vectors, "vec_id", "embedding").only().select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    one = materialise(plain.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    # equal vectors are told by a digest, so that only ids and digests are shuffled
    usable = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    digest = F.when(F.coalesce(usable, F.lit(False)), F.sha2(F.transform("embedding", lambda x: x + 0.0).cast("string"), 256))
    members = materialise(one.select("vec_id", digest.alias("digest")), "digests")
    classes = materialise(members.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "copies")
    n = classes.count()
    reps = one.join(classes.select(F.col("rep").alias("vec_id"), "weight"), "vec_id").select("vec_id", "weight", "embedding")
    tile = tile or min(max(n // 16, TILES[0]), TILES[1])
    pivots = pivots or min(PIVOTS, max(1, -(-n // tile)))
    chosen = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    centres = [unit([r.embedding])[0] for r in chosen]
    coded = materialise(reps.mapInArrow(_encode(centres), CODES), "codes")
    # cells are cut into tiles of about equal size by the hash of the id
    rows = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (F.col("dim") * 9))))
    cells = materialise(coded.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).withColumn("parts", F.ceil(F.col("n") / rows).cast("int")).select("dim", "cell", "parts", "radius"), "cells")
    known: dict[int, tuple] = {}
    for dim in {len(c) for c in centres}:  # lengths without a pivot are one cell each
        own = cells.where(F.col("dim") == dim).orderBy("cell").collect()
        known[dim] = np.stack([c for c in centres if len(c) == dim]), *(np.array([r[k] for r in own]) for k in ("cell", "parts", "radius"))
    pairs = materialise(cells.mapInArrow(_partners(known, float(np.arccos(threshold)) + 1e-6), "a string, b string"), "pairs")
    name = F.concat_ws("-", "dim", "cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("string"))
    path = write_keyed(coded.join(cells.select("dim", "cell", "parts"), ["dim", "cell"]).select(name.alias("tile"), "vec_id", "weight", "codes", "scale", "err", "vector"), "tile", "tiles")
    tasks = pairs.repartition(max(1, min(pairs.count(), 100_000)))
    found = materialise(tasks.mapInArrow(_product(path, threshold), "u long, v long, links long"), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.where("v is not null").select("u", "v")).select(F.col("node").alias("rep"), "root")
    discard(coded, path)
    whole = classes.join(links, "rep", "left").join(roots, "rep", "left").select("digest", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    return members.join(whole, "digest", "left").select("vec_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
