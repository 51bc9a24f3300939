"""Sinks. A path with a file's suffix gets one file, streamed by the driver; any other path a folder of parts, written by the executors."""

from __future__ import annotations

import codecs
import json
import math
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path, PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.types import dtypes, quoted
from tidewater.sources.remote import uri

_FORMULA = ("=", "+", "-", "@", "\t", "\r")


def escape_formulas(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet might run gets an apostrophe before it."""
    kinds = dtypes(df)
    out = [F.when(quoted(c).rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), quoted(c))).otherwise(quoted(c)).alias(c) if k == "string" else quoted(c) for c, k in kinds.items()]
    return df.select(*out)


def _text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return format(v, ".17g") if isinstance(v, float) else str(v)


def _field(v: str, delimiter: str) -> str:
    return '"' + v.replace('"', '""') + '"' if any(ch in v for ch in (delimiter, '"', "\n", "\r")) else v


def _csv_lines(df: DataFrame, delimiter: str, end: str) -> Iterator[str]:
    alone = len(df.columns) == 1
    for r in df.toLocalIterator(prefetchPartitions=True):
        line = delimiter.join(_field(_text(v), delimiter) for v in r)
        yield (line if line or not alone else '""') + end


def write_csv(df: DataFrame, path, *, append: bool = False, delimiter: str = ",", write_header: bool = True, line_terminator: str = "\n", escape_formulas: bool = False, safe_for_spreadsheet: bool = False, encoding: str = "utf-8", encoding_errors: str = "strict") -> None:
    """CSV: nulls empty, bools ``true`` and ``false``, floats with 17 digits, quotes only where needed.

    To a ``.csv``, ``.tsv`` or ``.txt`` path one file in the frame's order, which
    appears whole unless it is appended to; the columns of an appended file must
    agree. To any other path a folder of parts.
    """
    if len(delimiter) != 1:
        raise ValueError("write_csv: the delimiter must be one character")
    if line_terminator not in ("\n", "\r\n", "\r"):
        raise ValueError("write_csv: unknown line terminator")
    codecs.lookup(encoding)
    if escape_formulas or safe_for_spreadsheet:
        df = globals()["escape_formulas"](df)
    name = Path(path)
    if name.suffix.lower() not in (".csv", ".tsv", ".txt"):
        writer = df.write.mode("append" if append else "overwrite")
        writer.options(sep=delimiter, header=write_header, quote='"', escape='"', emptyValue="", nullValue="", encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(uri(str(path)))
        return
    there = append and name.exists() and name.stat().st_size > 0
    if there and write_header:
        with open(name, encoding=encoding, newline="") as f:
            import csv as pycsv

            have = next(pycsv.reader(f, delimiter=delimiter), [])
        if have != list(df.columns):
            raise ValueError(f"write_csv: the file has the columns {have}")
    header = delimiter.join(_field(c, delimiter) for c in df.columns) + line_terminator
    lines = _csv_lines(df, delimiter, line_terminator)
    if there:
        with open(name, "a", encoding=encoding, errors=encoding_errors, newline="") as f:
            f.writelines(lines)
        return
    _whole(name, ([header] if write_header else []), lines, encoding, encoding_errors)


def _whole(path: Path, head: list[str], lines: Iterator[str], encoding: str = "utf-8", errors: str = "strict", tail: str = "") -> None:
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    try:
        with os.fdopen(handle, "w", encoding=encoding, errors=errors, newline="") as f:
            f.writelines(head)
            f.writelines(lines)
            f.write(tail)
        os.chmod(temporary, 0o644)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def _finite(row) -> dict:
    out = row.asDict()
    for k, v in out.items():
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError(f"JSON has no form of {v} (column {k!r})")
    return out


def write_json(df: DataFrame, path, *, orient: str = "records", indent: int | None = None) -> None:
    """One JSON document: records, lists by column, or columns and data."""
    from tidewater.sources.memory import to_dict

    if orient not in ("records", "list", "split"):
        raise ValueError("write_json: orient must be records, list or split")
    name = Path(path)
    if orient == "records" and indent is None:
        rows = (json.dumps(_finite(r), ensure_ascii=False) for r in df.toLocalIterator(prefetchPartitions=True))
        _whole(name, ["["], ("," * bool(i) + x for i, x in enumerate(rows)), tail="]")
        return
    body = json.dumps(to_dict(df, orient), indent=indent, ensure_ascii=False, allow_nan=False)
    _whole(name, [body], iter(()))


def json_line(df: DataFrame) -> Column:
    """A row as compact JSON with its nulls; a float that JSON can't hold fails the job."""
    kinds = dtypes(df)
    cells = []
    for c, k in kinds.items():
        v = quoted(c)
        if k == "float64":
            v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"JSON has no form of a value of {c!r}")).cast("double")).otherwise(v)
        cells.append(v.alias(c))
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path, *, encoding: str = "utf-8", encoding_errors: str = "strict") -> None:
    """One object per line: one file for ``.jsonl``, ``.ndjson`` and ``.json``, else a folder of parts."""
    name = Path(path)
    if name.suffix.lower() not in (".jsonl", ".ndjson", ".json"):
        df.select(json_line(df).alias("value")).write.mode("overwrite").text(uri(str(path)))
        return
    lines = (json.dumps(_finite(r), ensure_ascii=False, separators=(",", ":")) + "\n" for r in df.toLocalIterator(prefetchPartitions=True))
    _whole(name, [], lines, encoding, encoding_errors)


def write_parquet(df: DataFrame, path, *, compression: str | None = "snappy", row_group_size: int | None = None) -> None:
    """A Parquet folder. ``row_group_size`` is in rows and becomes bytes by the types' widths."""
    if PurePath(str(path)).suffix.lower() not in (".parquet", ".pq"):
        raise ValueError("write_parquet: the path must end in .parquet or .pq")
    codec = "uncompressed" if compression is None else {"none": "uncompressed"}.get(compression, compression)
    if codec not in ("uncompressed", "snappy", "gzip", "brotli", "zstd"):
        raise ValueError("write_parquet: compression must be snappy, gzip, brotli, zstd or none")
    writer = df.write.mode("overwrite").option("compression", codec)
    if row_group_size is not None:
        if isinstance(row_group_size, bool) or not isinstance(row_group_size, int) or row_group_size <= 0:
            raise ValueError("write_parquet: row_group_size must be a positive integer")
        width = sum({"int64": 8, "float64": 8, "bool": 1}.get(k, 32) for k in dtypes(df).values())
        writer = writer.option("parquet.block.size", max(1024, row_group_size * width))
    writer.parquet(uri(str(path)))
