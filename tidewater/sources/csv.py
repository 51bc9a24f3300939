"""CSV: read as text by Spark, typed by the library's own inference.

Spark parses the records; one aggregate classes every cell of every column as
null, bool, integer, float or text; the typed frame is a lazy projection. With
all types given no aggregate runs. ``multiline=False`` lets Spark split files,
for data without line ends in quotes; the default reads a file whole, as quoted
line ends demand.
"""

from __future__ import annotations

import codecs
import csv as pycsv
import gzip
import io
import itertools
import os
import re
import tempfile
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import CsvReadError
from tidewater.functions import text
from tidewater.functions.types import SPARK, canonical, quoted
from tidewater.sources.remote import local, located, scratch, uri

BAD = "__tidewater_bad__"
DELIMITERS = (",", ";", "\t", "|")
_INT = r"\A[+-]?[0-9]+\z"
_FLOAT = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _open(path: str, encoding: str, errors: str = "replace"):
    handle = gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")
    return io.TextIOWrapper(handle, encoding="utf-8-sig" if encoding.lower().replace("_", "-") in ("utf-8", "utf8") else encoding, errors=errors, newline="")


def _beginning(spark: SparkSession, path: str, encoding: str, chars: int) -> str:
    """The first characters of a source, wherever it lies."""
    if name := local(path):
        with _open(name, encoding) as f:
            return f.read(chars)
    lines = spark.read.text(path).limit(1000).collect()
    return "\n".join(r[0] for r in lines)[:chars].removeprefix("﻿")


def sniff_delimiter(path, *, encoding: str = "utf-8", sample_size: int = 2048, spark: SparkSession | None = None) -> str:
    """The delimiter whose count per line is most constant in a sample; a tie, or none, is an error."""
    if isinstance(sample_size, bool) or not isinstance(sample_size, int) or sample_size <= 0:
        raise ValueError("sniff_delimiter: sample_size must be a positive integer")
    sample = _beginning(spark or session(), located(path), encoding, sample_size)
    lines = [x for x in sample.splitlines() if x.strip()]
    if len(sample) == sample_size and len(lines) > 1:
        lines.pop()
    if not lines:
        raise CsvReadError("sniff_delimiter: no lines to look at")
    scores = {}
    for d in DELIMITERS:
        counts = [n for n in (_bare(x).count(d) for x in lines) if n]
        if counts:
            mode, times = max(((n, counts.count(n)) for n in set(counts)), key=lambda x: (x[1], x[0]))
            scores[d] = 10 * times / len(lines) + 0.1 * mode
    best = sorted(scores, key=scores.get, reverse=True)
    if not best or (len(best) > 1 and scores[best[0]] == scores[best[1]]):
        raise CsvReadError("sniff_delimiter: no delimiter stands out")
    return best[0]


def _bare(line: str) -> str:
    return re.sub(r'"(?:[^"]|"")*"', "", line)


def _number(c: Column, decimal: str, thousands: str | None) -> tuple[Column, Column]:
    """A cell's text as plain number text, and whether its separators are malformed."""
    bare = text.strip(c)
    if decimal == "." and thousands is None:
        return bare, F.lit(False)
    d, t = re.escape(decimal), re.escape(thousands) if thousands else None
    grouped = rf"[0-9]{{1,3}}(?:{t}[0-9]{{3}})+" if t else "(?!)"
    fine = rf"\A[+-]?(?:{grouped}|[0-9]+)(?:{d}[0-9]*)?(?:[eE][+-]?[0-9]+)?\z|\A[+-]?{d}[0-9]+(?:[eE][+-]?[0-9]+)?\z"
    numeric = rf"\A[+-]?[0-9.,{t or ''}{d}]*[0-9][0-9.,{t or ''}{d}]*(?:[eE][+-]?[0-9]+)?\z"
    plain = F.regexp_replace(bare, t, "") if t else bare
    plain = F.regexp_replace(plain, d, ".") if decimal != "." else plain
    return F.when(bare.rlike(fine), plain).otherwise(bare), bare.rlike(numeric) & ~bare.rlike(fine)


class _Cells:
    """The expressions by which cells are classed and typed."""

    def __init__(self, decimal: str, thousands: str | None, nulls: list[str]):
        self.decimal, self.thousands, self.nulls = decimal, thousands, [n.lower() for n in nulls]

    def null(self, c: Column) -> Column:
        return c.isNull() | F.lower(c).isin("", *self.nulls)

    def kind(self, c: Column) -> Column:
        """n, b, i, f or s."""
        number, malformed = _number(c, self.decimal, self.thousands)
        low = text.lower(text.strip(c))
        integer = number.rlike(_INT)
        return (
            F.when(self.null(c), "n")
            .when(low.isin("true", "false"), "b")
            .when(low.isin("inf", "+inf", "-inf", "nan"), "f")
            .when(integer & number.rlike(r"\A[+-]?0[0-9]+\z"), "s")
            .when(integer, F.when(number.try_cast("long").isNotNull(), "i").otherwise("s"))
            .when(number.rlike(_FLOAT), "f")
            .when(malformed, "n")
            .otherwise("s")
        )

    def value(self, c: Column, to: str) -> Column:
        """The typed cell; null where it isn't of the type."""
        number, _ = _number(c, self.decimal, self.thousands)
        low = text.lower(text.strip(c))
        if to == "bool":
            out = F.when(low.isin("true"), True).when(low.isin("false"), False)
        elif to == "int64":
            out = F.when(number.rlike(_INT), number.try_cast("long"))
        elif to == "float64":
            out = F.when(low.isin("inf", "+inf"), float("inf")).when(low == "-inf", float("-inf")).when(low == "nan", float("nan")).when(number.rlike(_FLOAT), number.try_cast("double"))
        else:
            return F.when(~self.null(c), c)
        return F.when(~self.null(c), out)


def promote(kinds) -> str:
    """The type of a column that holds cells of these kinds."""
    found = set(kinds) - {"n", None}
    return "bool" if found == {"b"} else "int64" if found == {"i"} else "float64" if found and found <= {"i", "f"} else "string"


def infer(df: DataFrame, cells: _Cells, columns: list[str]) -> dict[str, str]:
    """Types of text columns, from one aggregate over all of them."""
    if not columns:
        return {}
    found = df.agg(*[F.collect_set(cells.kind(quoted(c))).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    return {c: promote(k) for c, k in zip(columns, found, strict=True)}


def _names(first: list[str], trim: bool) -> list[str]:
    out = [c.strip() if trim else c for c in first]
    if any(not c.strip() for c in out):
        raise CsvReadError("the header has an empty name")
    if len(set(out)) < len(out):
        raise CsvReadError(f"the header repeats {', '.join(sorted({c for c in out if out.count(c) > 1}))}")
    return out


def _skipped(path: str, n: int, encoding: str) -> str:
    """A copy of a local file without its first n lines."""
    name = local(path)
    if name is None:
        raise ValueError("skiprows needs a local file")
    handle, out = tempfile.mkstemp(dir=scratch(), suffix=".csv")
    with _open(name, encoding, "surrogateescape") as f, os.fdopen(handle, "w", encoding=encoding, errors="surrogateescape", newline="") as g:
        for _ in itertools.islice(f, n):
            pass
        while part := f.read(1 << 20):
            g.write(part)
    return out


#: Python's names of the encodings that Spark reads by itself, and Spark's.
_CHARSETS = {"utf-8": "utf-8", "utf-8-sig": "utf-8", "iso8859-1": "iso-8859-1", "ascii": "us-ascii", "utf-16": "utf-16", "utf-16-be": "utf-16be", "utf-16-le": "utf-16le", "utf-32": "utf-32"}


def _readable(path: str, encoding: str) -> tuple[str, str]:
    """A path and a charset that Spark reads: the file's own, or of a copy in UTF-8."""
    charset = _CHARSETS.get(codecs.lookup(encoding).name)
    if charset:
        return path, charset
    name = local(path)
    if name is None:
        raise ValueError(f"the encoding {encoding} needs a local file")
    handle, out = tempfile.mkstemp(dir=scratch(), suffix=".csv")
    with _open(name, encoding, "strict") as f, os.fdopen(handle, "w", encoding="utf-8", newline="") as g:
        while part := f.read(1 << 20):
            g.write(part)
    return out, "utf-8"


def _fields(delimiter: str):
    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else len(next(pycsv.reader(io.StringIO(v, newline=""), delimiter=delimiter), [])) for v in s], dtype="Int32")

    return count


def _raw(spark: SparkSession, path: str, *, delimiter: str, has_header: bool, encoding: str, trim_headers: bool, multiline: bool, encoding_errors: str) -> tuple[DataFrame, list[str]]:
    """Text columns plus ``BAD``, the raw text of records with another number of fields."""
    path, encoding = _readable(path, encoding)
    head = _beginning(spark, path, encoding, 1 << 20)
    if not head.strip():
        raise CsvReadError(f"{path} is empty")
    records = pycsv.reader(io.StringIO(head, newline=""), delimiter=delimiter)
    try:
        first = next(records)
        second = next(records, None)
    except pycsv.Error as error:
        raise CsvReadError(f"{path}: {error}") from error
    names = _names(first, trim_headers) if has_header else [f"col_{i}" for i in range(len(first))]
    if len(first) == 1:
        other = [d for d in DELIMITERS if d != delimiter and d in _bare(head.split("\n", 1)[0]) and (second is None or d in "".join(second))]
        if other:
            warnings.warn(f"one column was found; the delimiter may be {other[0]!r}", UserWarning, stacklevel=4)
    private = [f"c{i}" for i in range(len(names))]
    shape = T.StructType([T.StructField(c, T.StringType()) for c in [*private, BAD]])
    reader = spark.read.schema(shape).options(sep=delimiter, header=has_header, multiLine=multiline, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=True, encoding=encoding, maxCharsPerColumn=-1, columnPruning=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = reader.csv(uri(path))
    if encoding_errors == "ignore":
        df = df.select(*[F.translate(quoted(c), "�", "").alias(c) for c in df.columns])
    return df.toDF(*names, BAD), names


def _check_bytes(spark: SparkSession, path: str, encoding: str, errors: str) -> None:
    """Refuses NUL bytes, and with ``strict`` bytes that aren't UTF-8; one pass over the lines."""
    if codecs.lookup(encoding).name != "utf-8":
        return
    bad = spark.read.text(uri(path)).agg(F.max(F.contains("value", F.lit("\0"))), F.max(~F.is_valid_utf8("value"))).first()
    if bad[0]:
        raise CsvReadError(f"{path} holds NUL bytes")
    if errors == "strict" and bad[1]:
        raise CsvReadError(f"{path} is not valid UTF-8")


def _options(delimiter, nrows, skiprows, mode, on_bad_lines, encoding, encoding_errors, decimal, thousands) -> None:
    if not isinstance(delimiter, str) or len(delimiter) != 1:
        raise ValueError("read_csv: the delimiter must be one character")
    for what, n in (("nrows", nrows), ("skiprows", skiprows)):
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
            raise ValueError(f"read_csv: {what} must be an integer that isn't negative")
    for what, v, known in (("mode", mode, ("strict", "permissive")), ("on_bad_lines", on_bad_lines, ("error", "warn", "skip")), ("encoding_errors", encoding_errors, ("strict", "replace", "ignore"))):
        if v not in known:
            raise ValueError(f"read_csv: {what} must be one of {', '.join(known)}")
    try:
        codecs.lookup(encoding)
    except LookupError as error:
        raise ValueError(f"read_csv: unknown encoding {encoding!r}") from error
    if len(decimal) != 1 or (thousands is not None and len(thousands) != 1) or decimal == thousands:
        raise ValueError("read_csv: separators of numbers must be two different characters")


def read_csv(
    path,
    *,
    delimiter: str = ",",
    has_header: bool = True,
    usecols=None,
    nrows: int | None = None,
    skiprows: int | None = None,
    encoding: str = "utf-8",
    trim_headers: bool = True,
    decimal_separator: str = ".",
    thousands_separator: str | None = None,
    null_values=None,
    dtype: dict | None = None,
    mode: str = "strict",
    encoding_errors: str = "strict",
    on_bad_lines: str = "error",
    multiline: bool = True,
    check_bytes: bool = True,
    spark: SparkSession | None = None,
) -> DataFrame:
    """A typed frame of CSV from a path, a folder, a URL, a gzip file or a text handle.

    A record with too many fields is bad, and in ``strict`` mode one with too few;
    ``on_bad_lines`` raises, warns and drops, or drops. Bad records count
    towards ``nrows``. Text after a closing quote stays raw, with its quotes.
    """
    spark = spark or session()
    _options(delimiter, nrows, skiprows, mode, on_bad_lines, encoding, encoding_errors, decimal_separator, thousands_separator)
    at = located(path)
    if skiprows:
        at = _skipped(at, skiprows, encoding)
    if check_bytes:
        _check_bytes(spark, at, encoding, encoding_errors)
    raw, names = _raw(spark, at, delimiter=delimiter, has_header=has_header, encoding=encoding, trim_headers=trim_headers, multiline=multiline, encoding_errors=encoding_errors)
    if nrows is not None:
        raw = raw.limit(nrows)
    chosen = list(usecols) if usecols is not None else names
    if set(chosen) - set(names):
        raise ValueError(f"read_csv: usecols names no column {', '.join(sorted(set(chosen) - set(names)))}")
    # a second column, which is always long enough, since Spark refuses to read the corrupt record alone
    bad = F.col(BAD).isNotNull() & (F.coalesce(F.length(quoted(names[0])), F.lit(0)) >= 0)
    if mode == "permissive":
        bad = bad & (F.coalesce(_fields(delimiter)(F.col(BAD)), F.lit(0)) > len(names))
    if on_bad_lines != "skip":
        wrong = raw.where(bad).select(BAD).limit(5).collect()
        if wrong and on_bad_lines == "error":
            raise CsvReadError(f"a record doesn't have {len(names)} fields: {wrong[0][0]!r}")
        if wrong:
            warnings.warn(f"records without {len(names)} fields are dropped, such as {wrong[0][0]!r}", UserWarning, stacklevel=2)
    rows = raw.where(~F.coalesce(bad, F.lit(False)))
    cells = _Cells(decimal_separator, thousands_separator, list(null_values or []))
    given = {c: canonical(t) for c, t in (dtype or {}).items()}
    if set(given) - set(names):
        raise ValueError(f"read_csv: dtype names no column {', '.join(sorted(set(given) - set(names)))}")
    types = given | infer(rows, cells, [c for c in chosen if c not in given])
    return typed(rows, cells, {c: types[c] for c in chosen}, set(given))


def typed(rows: DataFrame, cells: _Cells, types: dict[str, str], checked: set[str] = frozenset()) -> DataFrame:
    """The typed projection; a cell that doesn't fit a checked column's type fails the job."""
    out = []
    for c, to in types.items():
        v = cells.value(quoted(c), to)
        if c in checked and to != "string":
            v = F.when(~cells.null(quoted(c)) & v.isNull(), F.raise_error(F.concat(F.lit(f"column {c!r} can't be {to}: "), quoted(c))).cast(SPARK[to])).otherwise(v)
        out.append(v.alias(c))
    return rows.select(*out)


def scan_csv(path, *, delimiter: str | None = None, encoding: str = "utf-8", skiprows: int | None = None, trim_headers: bool = True, decimal_separator: str = ".", thousands_separator: str | None = None, sample_size: int | None = None, null_values=None, has_header: bool = True, encoding_errors: str = "strict", on_bad_lines: str = "error", return_metadata: bool = False, spark: SparkSession | None = None):
    """Column types from a sample of the first records, 100 unless told otherwise."""
    spark = spark or session()
    n = 100 if sample_size is None else sample_size
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError("scan_csv: sample_size must be a positive integer")
    at = located(path)
    delimiter = delimiter or sniff_delimiter(at, encoding=encoding, spark=spark)
    _options(delimiter, None, skiprows, "strict", on_bad_lines, encoding, encoding_errors, decimal_separator, thousands_separator)
    if skiprows:
        at = _skipped(at, skiprows, encoding)
    raw, names = _raw(spark, at, delimiter=delimiter, has_header=has_header, encoding=encoding, trim_headers=trim_headers, multiline=True, encoding_errors=encoding_errors)
    sample = spark.createDataFrame(raw.limit(n).collect(), raw.schema)
    bad = sample.where(F.col(BAD).isNotNull()).count()
    if bad and on_bad_lines == "error":
        raise CsvReadError(f"{bad} records of the sample don't have {len(names)} fields")
    types = infer(sample.where(F.col(BAD).isNull()), _Cells(decimal_separator, thousands_separator, list(null_values or [])), names)
    return (types, {"delimiter": delimiter, "sampled_rows": sample.count(), "bad_rows": bad, "columns": names}) if return_metadata else types


def chunks_of(df: DataFrame, size: int) -> Iterator[DataFrame]:
    """Frames of ``size`` rows, one partition at a time on the driver."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while part := list(itertools.islice(rows, size)):
        yield df.sparkSession.createDataFrame(part, df.schema)


def read_csv_chunked(path, *, chunksize: int = 10_000, delimiter: str | None = None, skiprows: int | None = None, nrows: int | None = None, usecols=None, dtype: dict | None = None, null_values=None, decimal_separator: str = ".", thousands_separator: str | None = None, encoding: str = "utf-8", on_bad_lines: str = "error", has_header: bool = True, trim_headers: bool = True, mode: str = "strict", encoding_errors: str = "strict", spark: SparkSession | None = None) -> Iterator[DataFrame]:
    """Frames of at most ``chunksize`` rows. ``skiprows`` skips data rows.

    A column's type is that of the first chunk where it has a value; a later value
    that doesn't fit raises CsvReadError.
    """
    if isinstance(chunksize, bool) or not isinstance(chunksize, int) or chunksize <= 0:
        raise ValueError("read_csv_chunked: chunksize must be a positive integer")
    spark = spark or session()
    at = located(path)
    delimiter = delimiter or sniff_delimiter(at, encoding=encoding, spark=spark)
    _options(delimiter, nrows, skiprows, mode, on_bad_lines, encoding, encoding_errors, decimal_separator, thousands_separator)
    raw, names = _raw(spark, at, delimiter=delimiter, has_header=has_header, encoding=encoding, trim_headers=trim_headers, multiline=True, encoding_errors=encoding_errors)
    chosen = list(usecols) if usecols is not None else names
    cells = _Cells(decimal_separator, thousands_separator, list(null_values or []))
    types: dict[str, str] = {c: canonical(t) for c, t in (dtype or {}).items()}
    rows = itertools.islice(raw.toLocalIterator(prefetchPartitions=True), skiprows or 0, None if nrows is None else (skiprows or 0) + nrows)
    while part := list(itertools.islice(rows, chunksize)):
        good = [r for r in part if r[BAD] is None or (mode == "permissive" and len(next(pycsv.reader([r[BAD]], delimiter=delimiter), [])) < len(names))]
        if len(good) < len(part) and on_bad_lines == "error":
            raise CsvReadError(f"a record doesn't have {len(names)} fields")
        chunk = spark.createDataFrame(good, raw.schema)
        unknown = [c for c in chosen if c not in types]
        if unknown:
            found = chunk.agg(*[F.collect_set(cells.kind(quoted(c))).alias(f"k{i}") for i, c in enumerate(unknown)]).first()
            types |= {c: promote(k) for c, k in zip(unknown, found, strict=True) if set(k) - {"n"}}
        now = {c: types.get(c, "string") for c in chosen}
        numbers = [c for c in chosen if now[c] != "string"]
        if numbers:
            wrong = chunk.agg(*[F.count_if(~cells.null(quoted(c)) & cells.value(quoted(c), now[c]).isNull()).alias(f"w{i}") for i, c in enumerate(numbers)]).first()
            for c, n in zip(numbers, wrong, strict=True):
                if n:
                    raise CsvReadError(f"column {c!r} is {now[c]} by an earlier chunk; {n} values of this one don't fit")
        yield typed(chunk, cells, now)
