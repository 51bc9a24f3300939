"""Parquet."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession

from tidewater.functions.types import flat, quoted
from tidewater.sources.csv import session
from tidewater.sources.remote import located, uri


def read_parquet(path, *, columns=None, usecols=None, spark: SparkSession | None = None) -> DataFrame:
    """A flat frame of Parquet; only the columns asked for are read."""
    if columns is not None and usecols is not None:
        raise ValueError("read_parquet: give columns or usecols, not both")
    if PurePath(str(path)).suffix.lower() not in (".parquet", ".pq"):
        raise ValueError("read_parquet: the path must end in .parquet or .pq")
    df = (spark or session()).read.parquet(uri(located(path)))
    wanted = columns if columns is not None else usecols
    if wanted is not None:
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise ValueError(f"read_parquet: no column {', '.join(missing)}")
        df = df.select(*map(quoted, wanted))
    return flat(df, widen=True)
