"""Operators on the set and names of columns, and on columns made of others."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import regexes, text
from tidewater.functions.types import canonical, dtypes, is_text, names, quoted, renamed, require


def validate_columns_exist(df: DataFrame, columns, *, operation: str | None = None) -> DataFrame:
    """The frame, if it has the columns; else KeyError. No job runs."""
    require(df, [columns] if isinstance(columns, str) else columns, operation or "validate_columns_exist", KeyError)
    return df


def select_columns(df: DataFrame, columns) -> DataFrame:
    """The columns in the order asked for."""
    return df.select(*map(quoted, names(df, columns, "select_columns")))


def select_dtypes(df: DataFrame, include=None, exclude=None) -> DataFrame:
    """Columns by flat type."""
    want, drop = ({canonical(t) for t in ([x] if isinstance(x, str | type) else x or [])} for x in (include, exclude))
    if not want and not drop:
        raise ValueError("select_dtypes: nothing to include or exclude")
    if want & drop:
        raise ValueError(f"select_dtypes: both included and excluded: {', '.join(sorted(want & drop))}")
    kept = [c for c, k in dtypes(df).items() if (not want or k in want) and k not in drop]
    if not kept:
        raise ValueError("select_dtypes: no column is left")
    return df.select(*map(quoted, kept))


def drop_columns(df: DataFrame, columns) -> DataFrame:
    """The frame without the columns; they must exist, and one must be left."""
    gone = set(names(df, columns, "drop_columns", empty_ok=True))
    kept = [c for c in df.columns if c not in gone]
    if not kept:
        raise ValueError("drop_columns: no column would be left")
    return df.select(*map(quoted, kept))


def drop_columns_matching(df: DataFrame, pattern: str) -> DataFrame:
    """The frame without columns in whose name the pattern is found."""
    r = regexes.check(pattern, "drop_columns_matching")
    kept = [c for c in df.columns if not r.search(c)]
    if not kept:
        raise ValueError("drop_columns_matching: no column would be left")
    return df.select(*map(quoted, kept))


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns under new names, which must differ from each other and from those that stay."""
    require(df, mapping, "rename_columns")
    if any(not isinstance(n, str) for n in mapping.values()):
        raise TypeError("rename_columns: names must be strings")
    return renamed(df, [mapping.get(c, c) for c in df.columns], "rename_columns")


def rename_columns_matching(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    r = regexes.check(pattern, "rename_columns_matching")
    return renamed(df, [r.sub(replacement, c) for c in df.columns], "rename_columns_matching")


def trim_column_names(df: DataFrame) -> DataFrame:
    return renamed(df, [c.strip() for c in df.columns], "trim_column_names")


def clean_column_names(df: DataFrame, *, case_type: str = "lower") -> DataFrame:
    """Names of letters, digits and single underscores; an empty one becomes ``column``."""
    case = {"lower": str.lower, "upper": str.upper, "none": str, None: str}.get(case_type)
    if case is None:
        raise ValueError("clean_column_names: case_type must be lower, upper or none")
    new = [case(re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", c)).strip("_")) or case("column") for c in df.columns]
    return renamed(df, new, "clean_column_names")


def sanitize_column_names(df: DataFrame) -> DataFrame:
    """Names with single underscores and none at the ends."""
    return renamed(df, [re.sub(r"__+", "_", c).strip("_") for c in df.columns], "sanitize_column_names")


def slugify_column_names(df: DataFrame, on_duplicates: str = "raise") -> DataFrame:
    """Lower-case names of word characters; ``on_duplicates="suffix"`` numbers those that meet."""
    if on_duplicates not in ("raise", "suffix"):
        raise ValueError("slugify_column_names: on_duplicates must be raise or suffix")
    new = [re.sub(r"[^\w]", "", re.sub(r"[\s\-]+", "_", c.strip())).lower() for c in df.columns]
    return renamed(df, unique_names(new) if on_duplicates == "suffix" else new, "slugify_column_names")


def unique_names(columns: list[str]) -> list[str]:
    """Repeated names with the suffixes ``_1``, ``_2``, ..., past any that are taken."""
    taken, out = set(columns), []
    seen: set[str] = set()
    for c in columns:
        name, k = c, 0
        while name in seen or (k and name in taken):
            k += 1
            name = f"{c}_{k}"
        seen.add(name)
        out.append(name)
    return out


def make_column_names_unique(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def combine_columns(df: DataFrame, columns=None, output_column: str = "combined", *, separator: str = " ", subset=None, drop_original: bool = False) -> DataFrame:
    """Cells joined as text in order. A null is empty text between its separators; a row of nulls is null."""
    chosen = names(df, columns if columns is not None else subset, "combine_columns")
    if output_column in df.columns:
        raise ValueError(f"combine_columns: there is a column {output_column!r}")
    kinds = dtypes(df)
    parts = [F.coalesce(text.python_text(quoted(c), kinds[c]), F.lit("")) for c in chosen]
    out = df.withColumn(output_column, F.when(F.coalesce(*[quoted(c).cast("string") for c in chosen]).isNotNull(), F.concat_ws(separator, *parts)))
    return out.select(*[quoted(c) for c in out.columns if c not in chosen]) if drop_original else out


def coalesce_columns(df: DataFrame, *, subset, output_column: str = "coalesced") -> DataFrame:
    """The first cell of each row that isn't null. Columns of different types meet as text."""
    chosen = names(df, subset, "coalesce_columns")
    if output_column in df.columns:
        raise ValueError(f"coalesce_columns: there is a column {output_column!r}")
    kinds = dtypes(df)
    found = {kinds[c] for c in chosen}
    if len(found) == 1:
        cells = [quoted(c) for c in chosen]
    elif found == {"int64", "float64"}:
        cells = [quoted(c).cast("double") for c in chosen]
    else:
        cells = [text.python_text(quoted(c), kinds[c]) for c in chosen]
    return df.withColumn(output_column, F.coalesce(*cells))


def split_column(df: DataFrame, column: str, *, into, separator: str | None = None, pattern: str | None = None, keep_original: bool = False, check: bool = True) -> DataFrame:
    """Text cut into several columns, by a literal separator or by a pattern's groups.

    At most ``len(into)`` parts come of a cell; shorter ones leave nulls. With
    ``check``, one aggregate makes sure that some cell fills every column and
    none of the groups is left over.
    """
    require(df, [column], "split_column")
    into = list(into)
    if not into or len(set(into)) < len(into):
        raise ValueError("split_column: into needs distinct names")
    if (separator is None) == (pattern is None):
        raise ValueError("split_column: give either a separator or a pattern")
    if not is_text(df, column):
        raise TypeError("split_column: the column must be text")
    rest = [c for c in df.columns if keep_original or c != column]
    if set(into) & set(rest):
        raise ValueError(f"split_column: there are columns {', '.join(sorted(set(into) & set(rest)))}")
    c = quoted(column)
    if separator is not None:
        if not separator:
            raise ValueError("split_column: the separator is empty")
        parts = F.split(c, re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", separator), len(into))
        cells = [F.get(parts, F.lit(k)) for k in range(len(into))]
        if check:
            widest = df.agg(F.max(F.size(parts))).first()[0]
            if widest is not None and widest >= 0 and widest != len(into):
                raise ValueError(f"split_column: cells have {widest} parts, into has {len(into)}")
    else:
        r = regexes.check(pattern, "split_column")
        java = regexes.to_java(pattern)
        if r.groups != len(into) or java is None:
            raise ValueError("split_column: the pattern needs one group per new column" if java else "split_column: the pattern has no form on the JVM")
        cells = []
        for k in range(1, r.groups + 1):
            got = F.regexp_extract(c, java, k)
            cells.append(F.when(c.rlike(java), got))
    at = df.columns.index(column)
    out = []
    for k, name in enumerate(df.columns):
        if name != column or keep_original:
            out.append(quoted(name))
        if k == at:
            out += [cell.alias(n) for cell, n in zip(cells, into, strict=True)]
    return df.select(*out)


def encode_categorical(df: DataFrame, columns, method: str = "one_hot", ordinal_mappings: dict | None = None, max_categories: int = 10_000) -> DataFrame:
    """Text columns as numbers.

    ``one_hot`` replaces a column by one int64 column ``{column}_{value}`` for each
    of its values in order, found by one aggregate; a null has 0 in all. More
    than ``max_categories`` values are refused. ``ordinal`` maps values to
    given integers; nulls stay and a value without one fails the job.
    """
    chosen = names(df, columns, "encode_categorical")
    for c in chosen:
        if not is_text(df, c):
            raise TypeError(f"encode_categorical: {c!r} is not text")
    if method == "ordinal":
        if not ordinal_mappings or set(chosen) - set(ordinal_mappings):
            raise ValueError("encode_categorical: ordinal_mappings must cover every column")
        exprs = {}
        for c in chosen:
            out = F.when(quoted(c).isNull(), F.lit(None).cast("long"))
            for value, n in ordinal_mappings[c].items():
                if isinstance(n, bool) or not isinstance(n, int):
                    raise TypeError("encode_categorical: ordinals must be integers")
                out = out.when(quoted(c) == value, F.lit(n).cast("long"))
            exprs[c] = out.otherwise(F.raise_error(F.concat(F.lit(f"encode_categorical: no ordinal in {c!r} for "), quoted(c))).cast("long"))
        return df.select(*[exprs[c].alias(c) if c in exprs else quoted(c) for c in df.columns])
    if method != "one_hot":
        raise ValueError("encode_categorical: method must be one_hot or ordinal")
    values = {}
    for c in chosen:
        found = [r[0] for r in df.select(quoted(c)).where(quoted(c).isNotNull()).distinct().limit(max_categories + 1).collect()]
        if len(found) > max_categories:
            raise ValueError(f"encode_categorical: {c!r} has more than {max_categories} values")
        values[c] = sorted(found)
    out, new = [], []
    for c in df.columns:
        if c not in values:
            out.append(quoted(c))
            new.append(c)
        for v in values.get(c, ()):
            out.append(F.when(quoted(c) == v, 1).otherwise(0).cast("long").alias(f"{c}_{v}"))
            new.append(f"{c}_{v}")
    if len(set(new)) < len(new):
        raise ValueError("encode_categorical: new column names would repeat")
    return df.select(*out)


def rolling_window(data, window_size: int, stride: int = 1) -> list[list]:
    """Overlapping windows of a list, as lists."""
    for what, x in (("window_size", window_size), ("stride", stride)):
        if isinstance(x, bool) or not isinstance(x, int):
            raise TypeError(f"rolling_window: {what} must be an integer")
        if x <= 0:
            raise ValueError(f"rolling_window: {what} must be positive")
    data = list(data)
    if any(isinstance(x, list | tuple) for x in data):
        raise ValueError("rolling_window: the data must be one-dimensional")
    if window_size > len(data):
        raise ValueError("rolling_window: the window is longer than the data")
    return [data[i : i + window_size] for i in range(0, len(data) - window_size + 1, stride)]


def rolling_windows(df: DataFrame, column: str, window_size: int, stride: int = 1, *, partition_by, order_by) -> DataFrame:
    """Full windows of a column within partitions, as arrays: one row per window that begins at a stride."""
    from pyspark.sql import Window

    if window_size <= 0 or stride <= 0:
        raise ValueError("rolling_windows: sizes must be positive")
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    by = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(order_by))
    rows = df.select(*map(quoted, keys), (F.row_number().over(by) - 1).alias("start"), F.collect_list(quoted(column)).over(by.rowsBetween(0, window_size - 1)).alias("window"))
    return rows.where((F.size("window") == window_size) & (F.col("start") % stride == 0))

