"""Frames from and to pandas, Arrow, Polars, numpy, dicts, records and DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewater.functions.types import SPARK, canonical, dtypes, flat
from tidewater.sources.csv import session

_NULLABLE = {"int64": "Int64", "bool": "boolean", "string": "string", "float64": "float64"}


def _plain(v):
    """A scalar as the flat types hold it; None for NaN."""
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float | np.floating) and math.isnan(v)):
        return None
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63:
        raise ValueError(f"{v} is out of the range of int64")
    if not isinstance(v, str | int | float | bool):
        raise TypeError(f"{type(v).__name__} is not a flat value")
    return v


def _column(name: str, values: list, hint: str | None) -> tuple[list, str]:
    out = [_plain(v) for v in values]
    kinds = {type(v) for v in out if v is not None}
    kind = hint or ("bool" if kinds == {bool} else "int64" if kinds == {int} else "float64" if kinds and kinds <= {int, float} else "string")
    if kind == "string":
        out = [v if v is None or isinstance(v, str) else str(v) for v in out]
    elif kind == "float64":
        out = [None if v is None else float(v) for v in out]
    return out, kind


def from_columns(columns: dict[str, list], hints: dict | None = None, spark: SparkSession | None = None) -> DataFrame:
    hints = {c: canonical(t) for c, t in (hints or {}).items()}
    done = {c: _column(c, list(v), hints.get(c)) for c, v in columns.items()}
    shape = T.StructType([T.StructField(c, SPARK[k]) for c, (_, k) in done.items()])
    rows = list(zip(*(v for v, _ in done.values()), strict=True))
    return (spark or session()).createDataFrame(rows, shape)


def from_dict(data: dict, *, spark: SparkSession | None = None) -> DataFrame:
    """A frame of columns given as lists of one length."""
    if not isinstance(data, dict) or any(not isinstance(k, str) for k in data):
        raise TypeError("from_dict: need a dict with strings as keys")
    columns = {k: list(v) if not isinstance(v, str) else None for k, v in data.items()}
    if None in columns.values():
        raise TypeError("from_dict: each column must be a list")
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("from_dict: columns differ in length")
    return from_columns(columns, spark=spark)


def from_records(records, columns=None, *, spark: SparkSession | None = None) -> DataFrame:
    """A frame of dicts, or of lists or tuples with ``columns``."""
    rows = list(records)
    if not rows:
        raise ValueError("from_records: no records")
    if all(isinstance(r, dict) for r in rows):
        names = list(columns) if columns is not None else list(dict.fromkeys(k for r in rows for k in r))
        return from_columns({n: [r.get(n) for r in rows] for n in names}, spark=spark)
    if not all(isinstance(r, list | tuple) for r in rows):
        raise TypeError("from_records: records must be all dicts, or all lists or tuples")
    if columns is None:
        raise ValueError("from_records: lists and tuples need columns")
    names = list(columns)
    if any(len(r) != len(names) for r in rows):
        raise ValueError("from_records: a record doesn't have one value per column")
    return from_columns({n: [r[i] for r in rows] for i, n in enumerate(names)}, spark=spark)


def from_pandas(pdf: pd.DataFrame, *, dtype: dict | None = None, spark: SparkSession | None = None) -> DataFrame:
    """A frame of a pandas one; NaN becomes null. An index that isn't a plain range becomes columns."""
    if not isinstance(pdf, pd.DataFrame):
        raise TypeError("from_pandas: not a pandas DataFrame")
    if not isinstance(pdf.index, pd.RangeIndex):
        if pdf.index.names == [None]:
            pdf = pdf.rename_axis("index")
        pdf = pdf.reset_index()
    if not pdf.columns.is_unique or any(not isinstance(c, str) for c in pdf.columns):
        raise ValueError("from_pandas: column names must be distinct strings")
    hints = {c: canonical(t) for c, t in (dtype or {}).items()}
    out, fields = {}, []
    for c in pdf.columns:
        s = pdf[c]
        t = s.dtype
        if isinstance(t, pd.CategoricalDtype) or pd.api.types.is_datetime64_any_dtype(t) or pd.api.types.is_timedelta64_dtype(t) or pd.api.types.is_complex_dtype(t):
            raise TypeError(f"from_pandas: column {c!r} has the unsupported dtype {t}")
        if c not in hints and (pd.api.types.is_bool_dtype(t) or pd.api.types.is_integer_dtype(t) or pd.api.types.is_float_dtype(t)):
            kind = "bool" if pd.api.types.is_bool_dtype(t) else "int64" if pd.api.types.is_integer_dtype(t) else "float64"
            out[c] = pa.array(s, {"bool": pa.bool_(), "int64": pa.int64(), "float64": pa.float64()}[kind], from_pandas=True)
        else:
            values, kind = _column(c, s.tolist(), hints.get(c))
            out[c] = pa.array(values, {"bool": pa.bool_(), "int64": pa.int64(), "float64": pa.float64(), "string": pa.string()}[kind])
        fields.append(T.StructField(c, SPARK[kind]))
    if not out:
        return (spark or session()).createDataFrame([()] * len(pdf), T.StructType([]))
    return (spark or session()).createDataFrame(pa.table(out), T.StructType(fields))


def from_arrow(table: pa.Table, *, spark: SparkSession | None = None) -> DataFrame:
    """A frame of an Arrow table with flat columns; dictionaries of strings are text."""
    if not isinstance(table, pa.Table):
        raise TypeError("from_arrow: not a pyarrow Table")
    table = table.cast(pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in table.schema]))
    return flat((spark or session()).createDataFrame(table))


def from_polars(frame, *, spark: SparkSession | None = None) -> DataFrame:
    """A frame of a Polars one, by way of Arrow."""
    if not hasattr(frame, "to_arrow"):
        raise TypeError("from_polars: not a Polars DataFrame")
    return from_arrow(frame.to_arrow(), spark=spark)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def to_polars(df: DataFrame):
    try:
        import polars
    except ImportError as error:
        raise ImportError("to_polars needs polars") from error
    return polars.from_arrow(df.toArrow())


def to_pandas(df: DataFrame) -> pd.DataFrame:
    """A pandas frame with nullable dtypes: Int64, boolean, string, float64."""
    kinds = dtypes(df)
    return df.toPandas().astype({c: _NULLABLE[k] for c, k in kinds.items() if k in _NULLABLE})


def to_numpy(df: DataFrame, fill_value: Any = None) -> np.ndarray:
    """A matrix of the cells; nulls need a value to stand for them."""
    pdf = to_pandas(df)
    if fill_value is None and pdf.isna().any().any() and any(pdf[c].isna().any() for c in pdf if str(pdf[c].dtype) != "float64"):
        raise ValueError("to_numpy: there are nulls; give a fill_value")
    columns = [pdf[c].fillna(fill_value) if fill_value is not None else pdf[c] for c in pdf]
    kinds = set(dtypes(df).values())
    kind = bool if kinds == {"bool"} else np.int64 if kinds == {"int64"} else np.float64 if kinds <= {"int64", "float64"} and kinds else object
    return np.column_stack([c.to_numpy(dtype=kind) for c in columns]) if columns else np.empty((len(pdf), 0))


def to_dict(df: DataFrame, orient: str = "list"):
    """``list``: columns as lists; ``records``: rows as dicts; ``split``: columns and data."""
    if orient not in ("list", "records", "split"):
        raise ValueError("to_dict: orient must be list, records or split")
    rows = df.collect()
    if orient == "records":
        return [r.asDict() for r in rows]
    if orient == "split":
        return {"columns": list(df.columns), "data": [list(r) for r in rows]}
    return {c: [r[i] for r in rows] for i, c in enumerate(df.columns)}


def register_duckdb(df: DataFrame, name: str, connection=None):
    """The frame under a name in SQL: a temporary view in Spark and, given a connection, a table in DuckDB."""
    if not isinstance(name, str) or not name.isidentifier():
        raise ValueError("register_duckdb: the name must be an identifier")
    if connection is None:
        df.createOrReplaceTempView(name)
        return df.sparkSession
    connection.register(name, df.toArrow())
    return connection
