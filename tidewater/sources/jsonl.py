"""JSON Lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import JsonlReadError
from tidewater.functions.types import flat
from tidewater.operators.rowid import ROW, with_row_id
from tidewater.sources.csv import chunks_of, session
from tidewater.sources.remote import located, uri

_BAD = "__tidewater_corrupt__"


def read_jsonl(path, *, encoding: str = "utf-8", nrows: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """A flat frame of one object per line: the union of keys, absent ones null; blank lines don't count.

    A line that isn't an object raises JsonlReadError with its number from 1;
    nested values are refused. ``nrows=0`` gives the columns without rows.
    """
    spark = spark or session()
    if nrows is not None and (isinstance(nrows, bool) or not isinstance(nrows, int) or nrows < 0):
        raise ValueError("read_jsonl: nrows must be an integer that isn't negative")
    at = uri(located(path))
    reader = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, encoding=encoding, lineSep="\n", prefersDecimal=False)
    df = reader.json(at)
    if _BAD in df.columns:
        lines = with_row_id(spark.read.option("lineSep", "\n").text(at)).where(F.trim("value") != "")
        obj = F.try_parse_json("value")
        bad = lines.where(obj.isNull() | (F.schema_of_variant(F.coalesce(obj, F.parse_json(F.lit("0")))).substr(1, 6) != "OBJECT")).orderBy(ROW).first()
        where = f"line {bad[ROW] + 1}" if bad else "a line"
        raise JsonlReadError(f"{path}: {where} is not a JSON object")
    if not df.columns:
        raise JsonlReadError(f"{path} has no records")
    order = _key_order(spark, at, df.columns)
    out = flat(df.select(*order))
    return out if nrows is None else out.limit(nrows)


def _key_order(spark: SparkSession, path: str, columns: list[str]) -> list[str]:
    """Columns in the order in which the first lines name them; others after these, by name."""
    import json

    seen: dict[str, None] = {}
    for r in spark.read.text(path).where(F.trim("value") != "").limit(100).collect():
        seen |= dict.fromkeys(json.loads(r[0]))
    known = [c for c in seen if c in columns]
    return ["`" + c.replace("`", "``") + "`" for c in known + sorted(set(columns) - set(known))]


def read_jsonl_chunked(path, *, chunksize: int = 10_000, encoding: str = "utf-8", nrows: int | None = None, spark: SparkSession | None = None) -> Iterator[DataFrame]:
    """``read_jsonl`` in frames of at most ``chunksize`` rows, all of one schema."""
    if isinstance(chunksize, bool) or not isinstance(chunksize, int) or chunksize <= 0:
        raise ValueError("read_jsonl_chunked: chunksize must be a positive integer")
    yield from chunks_of(read_jsonl(path, encoding=encoding, nrows=nrows, spark=spark), chunksize)
