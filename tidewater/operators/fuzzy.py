"""Fuzzy duplicates by difflib's ratio.

Pairs are found without a cross join of rows. Equal rows are grouped first. The
ratio of two texts is at most 2 min / (la + lb) for their lengths, so at a
threshold t a text meets only lengths within [l t / (2 - t), l (2 - t) / t]:
rows are put in length bands of geometric width, and only neighbouring bands are
compared. Then the multiset bound of their letters, and at last the real ratio,
are applied to what is left, in batches.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.functions.types import dtypes, names, quoted
from tidewater.operators.rowid import ROW, with_row_id


def similarity(a: list, b: list, is_text: list[bool]) -> float:
    """Mean over columns of the ratio of texts, or of equality of other values."""
    total = 0.0
    for x, y, t in zip(a, b, is_text, strict=True):
        if t:
            x, y = x or "", y or ""
            total += 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
        else:
            total += x == y if x is not None or y is not None else True
    return total / len(a)


def bound(a: list, b: list, is_text: list[bool]) -> float:
    """An upper bound of ``similarity`` from letter counts."""
    total = 0.0
    for x, y, t in zip(a, b, is_text, strict=True):
        if t:
            x, y = x or "", y or ""
            size = len(x) + len(y)
            total += 2 * sum((Counter(x) & Counter(y)).values()) / size if size else 1.0
        else:
            total += x == y
    return total / len(a)


def find_fuzzy_duplicates(df: DataFrame, *, subset=None, threshold: float = 0.85, ignore_case: bool = True, normalize_whitespace: bool = True, max_rows: int = 50_000, order_by=None) -> list[list[int]]:
    """Groups of 0-based row numbers whose rows resemble each other, directly or through others.

    Without a subset, more than ``max_rows`` rows are refused. Groups are in the
    order of their first row.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("find_fuzzy_duplicates: threshold must be within 0 and 1")
    chosen = names(df, subset, "find_fuzzy_duplicates")
    pairs = fuzzy_pairs(df, chosen, threshold, ignore_case, normalize_whitespace, max_rows if subset is None else None, order_by)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs.toLocalIterator():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for x in sorted(parent):
        groups.setdefault(root(x), []).append(x)
    return [g for _, g in sorted(groups.items()) if len(g) > 1]


def fuzzy_pairs(df: DataFrame, columns: list[str], threshold: float, ignore_case: bool = True, normalize_whitespace: bool = True, max_rows: int | None = None, order_by=None) -> DataFrame:
    """(a, b) of row numbers, a < b, that join the rows of each fuzzy group; equal rows are joined to their first."""
    kinds = dtypes(df)
    is_text = [kinds[c] == "string" for c in columns]
    cells = []
    for c, t in zip(columns, is_text, strict=True):
        cell = quoted(c)
        if t:
            cell = F.coalesce(cell, F.lit(""))
            cell = text.collapse(cell) if normalize_whitespace else cell
            cell = F.lower(cell) if ignore_case else cell
        else:
            cell = cell.cast("string")
        cells.append(cell)
    rows = with_row_id(df, order_by).select(F.col(ROW).alias("id"), F.array(*cells).alias("cells"))
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"find_fuzzy_duplicates: more than {max_rows} rows; give a subset")
    one = rows.groupBy("cells").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids"))
    same = one.select("id", F.explode("ids").alias("b")).where("b > id").select(F.col("id").alias("a"), "b")
    length = sum((F.length(F.get("cells", F.lit(k))) for k, t in enumerate(is_text) if t), F.lit(0))
    # the mean over m columns of which k are text reaches t only if the text part reaches this
    m, k = len(columns), sum(is_text)
    need = (threshold * m - (m - k)) / k if k else 0
    base = one.select("id", "cells", length.alias("len"))
    if k == 1 and 0 < need < 1:
        width = math.log((2 - need) / need) + 1e-9
        band = F.floor(F.log(F.col("len") + 1.0) / width).cast("int")
        base = base.withColumn("band", band)
        other = base.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
        left, right = base.alias("x"), other.alias("y")
        met = left.join(right, F.col("x.band") == F.col("y.band")).where("x.id <> y.id").where(F.least("x.len", "y.len") * 2 >= need * (F.col("x.len") + F.col("y.len")))
    else:
        met = base.alias("x").crossJoin(base.alias("y")).where("x.id < y.id")
    met = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.when(F.col("x.id") < F.col("y.id"), F.col("x.cells")).otherwise(F.col("y.cells")).alias("p"), F.when(F.col("x.id") < F.col("y.id"), F.col("y.cells")).otherwise(F.col("x.cells")).alias("q")).distinct()

    @F.pandas_udf("boolean")
    def alike(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([bound(x, y, is_text) >= threshold - 1e-12 and similarity(x, y, is_text) >= threshold for x, y in ((list(x), list(y)) for x, y in zip(p, q, strict=True))], dtype=bool)

    return met.where(alike("p", "q")).select("a", "b").union(same)
