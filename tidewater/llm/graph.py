"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm._frame import materialise


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = F.least("u", F.min("v").over(Window.partitionBy("u")))
    return both.select("u", "v", low.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
    return low.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long), root the least node of its component, roots left out.

    Edges with a null end and loops are ignored; no edges give no rows. Each
    round is written to the shared folder, so lineage doesn't grow. The stars
    shrink components at least as fast as pointer doubling, so rounds grow with
    the logarithm of the longest path.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        now = materialise(_small(_large(now)), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
