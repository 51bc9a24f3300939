"""Exact quantiles by counting.

A first pass counts values in bins that follow their logarithm; each further one
counts only what fell into a bin that holds a wanted rank, in finer bins, until
such bins hold a single value. No task sees more than the counts of bins, at most
``BINS`` or ``FEW`` of them for a wanted rank, however many rows and values there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First bins to a unit of the natural logarithm (at most 91,000 in all); finer bins of a bin; values of a bin that are counted one by one; columns to a pass.
PER_UNIT, BINS, FEW, TOGETHER = 64, 1 << 16, 100_000, 16


def _counted(df: DataFrame, cells: list[Column], some: Column | None = None) -> DataFrame:
    """(at, key, n, lo, hi, end) of structs of (at, key, x): rows, least and greatest x of each key, and rows up to it.

    ``some`` tells which rows have a cell at all; of the others no structs are made.
    """
    all_of_them = F.array(*cells)
    bins = df.select(F.explode(all_of_them if some is None else F.when(some, all_of_them)).alias("c")).select("c.*").where("at is not null and key is not null").groupBy("at", "key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return bins.withColumn("end", F.sum("n").over(Window.partitionBy("at").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))


def _ranks(n: int, p: float) -> tuple[float, int, int]:
    position = (n - 1) * p
    return position, math.floor(position), math.ceil(position)


def _inside(rank, end, n):
    return (rank < end) & (rank >= end - n)


def quantiles(df: DataFrame, columns: list[Column], at: list[float]) -> list[list[float] | None]:
    """For each double column its quantiles (linear interpolation, as ``percentile``); None for one without values.

    Nulls are left out; values must be finite. The frame is read two to three
    times for usual columns, and once more for each factor of ``BINS`` in the
    range of a bin of over ``FEW`` rows.
    """
    out = []
    for k in range(0, len(columns), TOGETHER):
        out += _some(df, columns[k : k + TOGETHER], at)
    return out


def _some(df: DataFrame, columns: list[Column], at: list[float]) -> list[list[float] | None]:
    # each value is asked for many times, so it is found once
    df = df.select(*[x.alias(f"x{i}") for i, x in enumerate(columns)])
    columns = [F.col(f"x{i}") for i in range(len(columns))]

    def cell(i, x, key):
        return F.struct(i.cast("int").alias("at"), key.cast("double").alias("key"), x.alias("x"))

    first = _counted(df, [cell(F.lit(i), x, F.floor(F.signum(x) * F.log1p(F.abs(x)) * PER_UNIT)) for i, x in enumerate(columns)])
    first = first.withColumn("rows", F.sum("n").over(Window.partitionBy("at")))
    wanted = F.lit(False)
    for p in at:
        position = (F.col("rows") - 1) * F.lit(float(p))
        for rank in (F.floor(position), F.ceil(position)):
            wanted = wanted | _inside(rank, F.col("end"), F.col("n"))
    rows: dict[int, int] = {}
    bins = []
    for r in first.where(wanted).collect():
        rows[r["at"]] = r["rows"]
        bins.append((r["at"], r["end"] - r["n"], r["n"], r["lo"], r["hi"]))
    ranks = {i: sorted({r for p in at for r in _ranks(n, float(p))[1:]}) for i, n in rows.items()}
    found: dict[tuple[int, int], float] = {}
    while True:
        wide = []
        for b in bins:
            i, before, n, lo, hi = b
            inside = [r for r in ranks[i] if before <= r < before + n]
            if lo < hi:
                wide.append((b, inside))
            else:
                found |= {(i, r): lo + 0.0 for r in inside}
        if not wide:
            break
        cells, wanted, some = [], F.lit(False), F.lit(False)
        for i, x in enumerate(columns):
            which, key = F.lit(None), F.lit(None)
            for t, ((j, before, n, lo, hi), inside) in enumerate(wide):
                if i == j:
                    # each step of the finer bin is monotone in x, rounding included
                    here, fine = x.between(lo, hi), x if n <= FEW else F.least(F.lit(float(BINS - 1)), F.floor((x - lo) / (hi - lo) * BINS).cast("double"))
                    some = some | here
                    which, key = F.when(here, F.lit(t)).otherwise(which), F.when(here, fine).otherwise(key)
                    for r in inside:
                        wanted = wanted | ((F.col("at") == t) & _inside(F.lit(r - before), F.col("end"), F.col("n")))
            if any(j == i for (j, *_), _ in wide):
                cells.append(cell(which, x, key))
        bins = [(wide[r["at"]][0][0], wide[r["at"]][0][1] + r["end"] - r["n"], r["n"], r["lo"], r["hi"]) for r in _counted(df, cells, some).where(wanted).collect()]
        if not {(j, r) for (j, *_), inside in wide for r in inside} <= {(j, r) for j, before, n, *_ in bins for r in ranks[j] if before <= r < before + n}:
            raise RuntimeError("quantiles: the frame's values change from one reading to the next")

    def value(i: int, p: float) -> float:
        position, low, high = _ranks(rows[i], p)
        a, b = found[i, low], found[i, high]
        return a if a == b else (high - position) * a + (position - low) * b

    return [[value(i, float(p)) for p in at] if i in rows else None for i in range(len(columns))]
