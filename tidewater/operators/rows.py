"""Operators that keep or drop rows."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.types import dtypes, is_number, names, quoted, require
from tidewater.operators.rowid import ROW, with_row_id

_COMPARE = {
    ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
}


def filter_rows(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Rows whose cell compares so with ``value``; a null cell never does.

    Text and numbers aren't ordered against each other (TypeError); across
    types ``==`` keeps nothing and ``!=`` every cell that isn't null.
    """
    require(df, [column], "filter_rows", KeyError)
    if op not in _COMPARE:
        raise ValueError(f"filter_rows: unknown operator {op!r}; use one of {' '.join(_COMPARE)}")
    if value is None or (isinstance(value, float) and value != value):
        raise ValueError("filter_rows: the value must not be null")
    c, kind = quoted(column), dtypes(df)[column]
    fits = {"string": isinstance(value, str), "bool": isinstance(value, bool)}.get(kind, isinstance(value, int | float) if kind in ("int64", "float64") else True)
    if not fits:
        if op not in ("==", "!="):
            raise TypeError(f"filter_rows: can't order a {kind} column against {type(value).__name__}")
        return df.filter(c.isNotNull()) if op == "!=" else df.filter(F.lit(False))
    if kind in ("int64", "float64") and isinstance(value, bool):
        value = int(value)
    if kind == "int64" and isinstance(value, float):
        c = c.cast("double")
    return df.filter(_COMPARE[op](c, F.lit(value)))


def drop_nulls(df: DataFrame, *, subset=None) -> DataFrame:
    """Rows without a null in the subset; NaN is a value."""
    return df.filter(reduce(and_, [quoted(c).isNotNull() for c in names(df, subset, "drop_nulls")]))


def keep_rows_with_nulls(df: DataFrame, *, subset=None) -> DataFrame:
    """Rows with at least one null in the subset."""
    return df.filter(reduce(or_, [quoted(c).isNull() for c in names(df, subset, "keep_rows_with_nulls")]))


def drop_duplicates(df: DataFrame, *, subset=None, keep="first", order_by=None) -> DataFrame:
    """One row, or with ``keep=False`` or ``"none"`` no row, of each set that agrees on the subset.

    Nulls agree, and so do NaNs. ``order_by`` says which row is first; without it
    that is the order of the source, which costs a numbering of the rows. Where
    all columns are keys the rows of a set are the same and none is numbered.
    """
    keys = names(df, subset, "drop_duplicates")
    if keep is False:
        keep = "none"
    if keep not in ("first", "last", "none"):
        raise ValueError("drop_duplicates: keep must be 'first', 'last', 'none' or False")
    by = Window.partitionBy(*map(quoted, keys))
    if keep == "none":
        return df.withColumn("__n", F.count(F.lit(1)).over(by)).filter("__n = 1").drop("__n")
    if set(keys) == set(df.columns) and order_by is None:
        return df.dropDuplicates()
    if order_by is None:
        df, order = with_row_id(df), [ROW]
    else:
        order = [order_by] if isinstance(order_by, str) else list(order_by)
    order = [quoted(c) if isinstance(c, str) else c for c in order]
    direction = [c.desc() if keep == "last" else c.asc() for c in order]
    return df.withColumn("__n", F.row_number().over(by.orderBy(*direction))).filter("__n = 1").drop("__n", ROW)


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Columns with more than one distinct value, null being one; a frame without rows stays."""
    if not df.columns:
        return df
    distinct = [F.count_distinct(quoted(c)) + F.max(quoted(c).isNull().cast("int")) for c in df.columns]
    found = df.agg(F.count(F.lit(1)), *distinct).first()
    return df if not found[0] else df.select(*[quoted(c) for c, n in zip(df.columns, found[1:], strict=True) if n != 1])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns with a cell that is neither null nor the empty string; a frame without rows stays."""
    if not df.columns:
        return df
    kinds = dtypes(df)
    full = [F.max((quoted(c).isNotNull() & ((quoted(c) != "") if kinds[c] == "string" else F.lit(True))).cast("int")) for c in df.columns]
    found = df.agg(F.count(F.lit(1)), *full).first()
    return df if not found[0] else df.select(*[quoted(c) for c, n in zip(df.columns, found[1:], strict=True) if n])


def head(df: DataFrame, n: int = 5) -> DataFrame:
    _whole(n, "head")
    return df.limit(n)


def tail(df: DataFrame, n: int = 5) -> DataFrame:
    """The last n rows in the order of the source."""
    _whole(n, "tail")
    return df.sparkSession.createDataFrame(df.tail(n), df.schema) if n else df.limit(0)


def _whole(n, what: str) -> None:
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError(f"{what}: n must be an integer")
    if n < 0:
        raise ValueError(f"{what}: n must not be negative")


def clip_bounds(df: DataFrame, columns: list[str], what: str) -> list[str]:
    """Numeric columns of a subset; others are refused."""
    bad = [c for c in columns if not is_number(df, c)]
    if bad:
        raise ValueError(f"{what}: not numeric: {', '.join(bad)}")
    return columns
