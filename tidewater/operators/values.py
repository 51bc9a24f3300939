"""Operators on the values of columns; each is one projection, after at most one aggregate that it needs."""

from __future__ import annotations

import math
import warnings
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import TypeCastError
from tidewater.functions import text
from tidewater.functions.types import SPARK, canonical, dtypes, is_number, is_text, names, quoted, require, with_exprs
from tidewater.operators.quantiles import quantiles
from tidewater.operators.rowid import ROW, with_row_id
from tidewater.operators.rows import clip_bounds

MISSING_TOKENS = ("N/A", "NA", "n/a", "na", "-", "none", "nil", "null", "", "?")
TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")


def _texts(df: DataFrame, subset, what: str, strict: bool = False) -> list[str]:
    chosen = names(df, subset, what)
    if strict and (bad := [c for c in chosen if not is_text(df, c)]):
        raise TypeError(f"{what}: not text: {', '.join(bad)}")
    return [c for c in chosen if is_text(df, c)]


def _each(df: DataFrame, columns: list[str], f) -> DataFrame:
    return with_exprs(df, {c: f(quoted(c)) for c in columns})


def strip_whitespace(df: DataFrame, *, subset=None) -> DataFrame:
    """Text without ASCII white space at its ends."""
    return _each(df, _texts(df, subset, "strip_whitespace"), text.strip)


def normalize_whitespace(df: DataFrame, *, columns=None, subset=None) -> DataFrame:
    """Text with each run of Unicode white space as one space, and none at the ends."""
    return _each(df, _texts(df, columns if columns is not None else subset, "normalize_whitespace"), text.collapse)


def remove_control_characters(df: DataFrame, *, subset=None) -> DataFrame:
    return _each(df, _texts(df, subset, "remove_control_characters"), text.without_controls)


def normalize_case(df: DataFrame, *, subset=None, case_type: str = "lower") -> DataFrame:
    """ASCII letters in lower, upper or title case."""
    f = {"lower": text.lower, "upper": text.upper, "title": text.title}.get(case_type)
    if f is None:
        raise ValueError("normalize_case: case_type must be lower, upper or title")
    return _each(df, _texts(df, subset, "normalize_case"), f)


def normalize_unicode(df: DataFrame, *, subset=None, form: str = "NFC") -> DataFrame:
    """Text in a Unicode normal form; ASCII text, which every form leaves alone, doesn't leave the JVM's batch."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError("normalize_unicode: form must be NFC, NFD, NFKC or NFKD")

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return _each(df, _texts(df, subset, "normalize_unicode"), normal)


def hash_columns(df: DataFrame, *, subset, algorithm: str = "sha256") -> DataFrame:
    """Hex digests of text; nulls stay."""
    f = {"sha256": lambda c: F.sha2(c, 256), "md5": F.md5}.get(algorithm)
    if f is None:
        raise ValueError("hash_columns: algorithm must be sha256 or md5")
    return _each(df, _texts(df, subset, "hash_columns", strict=True), f)


def literal(value, kind: str, what: str):
    """A Python value as a flat type, or an error where it doesn't fit."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"{what}: the value must be finite")
    if kind == "string" and isinstance(value, str):
        return value
    if kind == "bool" and isinstance(value, bool):
        return value
    if kind in ("int64", "float64") and isinstance(value, int | float) and not isinstance(value, bool):
        if kind == "float64":
            return float(value)
        if float(value).is_integer():
            if not -(2**63) <= int(value) < 2**63:
                raise ValueError(f"{what}: {value} is out of the range of int64")
            return int(value)
        raise ValueError(f"{what}: {value!r} is not a whole number")
    raise ValueError(f"{what}: {value!r} doesn't fit a {kind} column")


def fill_nulls(df: DataFrame, value, *, subset=None) -> DataFrame:
    """Nulls replaced by a value that must fit every target column; NaN stays."""
    kinds = dtypes(df)
    new = {c: literal(value, kinds[c], f"fill_nulls({c})") for c in names(df, subset, "fill_nulls")}
    return with_exprs(df, {c: F.coalesce(quoted(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in new.items()})


_GUARDS = {
    "int64": r"^[ \t\n\x0B\f\r]*[+-]?[0-9]+$",
    "float64": r"^[ \t\n\x0B\f\r]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$",
    "bool": r"(?i)^[ \t\n\x0B\f\r]*(?:true|false|1|0)[ \t\n\x0B\f\r]*$",
}


def cast_text(c: Column, to: str) -> Column:
    """Text as another type; null where it isn't one."""
    if to == "string":
        return c
    if to == "bool":
        return F.when(c.rlike(_GUARDS["bool"]), text.lower(text.strip(c)).isin("true", "1"))
    out = text.strip(c).try_cast(SPARK[to])
    if to == "float64":
        out = F.when(F.abs(out) < float("inf"), out)
    return F.when(c.rlike(_GUARDS[to] + r"(?!\n)"), out)


def cell_text(c: Column, kind: str) -> Column:
    """The text through which a cast goes."""
    if kind == "float64":
        return F.format_string("%f", c)
    if kind == "bool":
        return F.when(c, "true").when(~c, "false")
    return c.cast("string")


def cast_types(df: DataFrame, mapping: dict, *, errors: str = "raise", order_by=None):
    """Columns cast by way of their text.

    ``raise`` fails at the first value that doesn't fit, ``coerce`` makes it
    null, and ``report`` gives (frame, failures), failures being a frame of
    (column, row, value, target) with 0-based rows. A float64 column doesn't
    fit int64: its text has a decimal point.
    """
    if errors not in ("raise", "coerce", "report"):
        raise ValueError("cast_types: errors must be raise, coerce or report")
    require(df, mapping, "cast_types")
    kinds = dtypes(df)
    targets = {c: canonical(t) for c, t in mapping.items()}
    exprs, failed = {}, {}
    for c, to in targets.items():
        if kinds[c] == to:
            exprs[c] = quoted(c)
            continue
        source = cell_text(quoted(c), kinds[c])
        cast = cast_text(source, to)
        bad = quoted(c).isNotNull() & cast.isNull()
        failed[c] = (bad, source, to)
        if errors == "raise":
            message = F.concat(F.lit(f"cast_types: column {c!r} can't be {to}: "), source)
            cast = F.when(bad, F.raise_error(message).cast(SPARK[to])).otherwise(cast)
        exprs[c] = cast
    out = with_exprs(df, exprs)
    if errors != "report":
        return out
    numbered = with_row_id(df, order_by)
    rows = [F.when(bad, F.struct(F.lit(c).alias("column"), F.col(ROW).alias("row"), source.alias("value"), F.lit(to).alias("target"))) for c, (bad, source, to) in failed.items()]
    if not rows:
        return out, df.sparkSession.createDataFrame([], "column string, row long, value string, target string")
    return out, numbered.select(F.explode(F.array_compact(F.array(*rows))).alias("f")).select("f.*")


def checked_cast(df: DataFrame, mapping: dict) -> DataFrame:
    """``cast_types`` with the values checked now: TypeCastError instead of a failing job later."""
    out, failures = cast_types(df, mapping, errors="report")
    first = failures.orderBy("row").first()
    if first:
        raise TypeCastError(f"column {first['column']!r}, row {first['row'] + 1}: {first['value']!r} can't be {first['target']}")
    return out


def parse_bool_strings(df: DataFrame, *, subset=None, true_values=None, false_values=None) -> DataFrame:
    """Text columns of nothing but truth words as bool.

    Words are compared trimmed and without case. In a column with other text the
    words become ``true`` and ``false`` and the rest stays. One aggregate looks
    at all the columns.
    """
    yes, no = ([str(v).strip().lower() for v in (given or own)] for given, own in ((true_values, TRUE), (false_values, FALSE)))
    if set(yes) & set(no):
        raise ValueError("parse_bool_strings: a word is both true and false")
    columns = _texts(df, subset, "parse_bool_strings")
    if not columns:
        return df
    word = {c: F.lower(text.strip_unicode(quoted(c))) for c in columns}
    all_words = df.agg(*[F.min((word[c].isin(yes + no)).cast("int")) for c in columns]).first()
    exprs = {}
    for c, every in zip(columns, all_words, strict=True):
        t, f = word[c].isin(yes), word[c].isin(no)
        if every:
            exprs[c] = F.when(t, True).when(f, False)
        else:
            exprs[c] = F.when(t, "true").when(f, "false").otherwise(quoted(c))
    return with_exprs(df, exprs)


def parse_numeric_strings(df: DataFrame, *, subset=None, errors: str = "coerce") -> DataFrame:
    """Text such as ``$1,200`` or ``12%`` as float64; what isn't a number is null, or fails with ``raise``."""
    if errors not in ("coerce", "raise"):
        raise ValueError("parse_numeric_strings: errors must be coerce or raise")
    exprs = {}
    for c in _texts(df, subset, "parse_numeric_strings"):
        bare = F.regexp_replace(text.strip_unicode(quoted(c)), r"[$,£€]", "")
        percent = bare.endswith("%")
        number = cast_text(text.strip_unicode(F.regexp_replace(bare, r"%$", "")), "float64")
        value = F.when(percent, number / 100).otherwise(number)
        if errors == "raise":
            value = F.when(quoted(c).isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"parse_numeric_strings: column {c!r}: "), quoted(c))).cast("double")).otherwise(value)
        exprs[c] = value
    return with_exprs(df, exprs)


def standardize_missing_tokens(df: DataFrame, tokens=None, subset=None) -> DataFrame:
    """Text that is one of the tokens as null."""
    tokens = list(MISSING_TOKENS if tokens is None else tokens)
    if any(not isinstance(t, str) for t in tokens):
        raise TypeError("standardize_missing_tokens: tokens must be strings")
    return _each(df, _texts(df, subset, "standardize_missing_tokens"), lambda c: F.when(~c.isin(tokens), c)) if tokens else df


def _mapped(df: DataFrame, mapping: dict, columns: list[str], what: str) -> DataFrame:
    if not isinstance(mapping, dict):
        raise TypeError(f"{what}: the mapping must be a dict")
    for v in (*mapping, *mapping.values()):
        if v is not None and not isinstance(v, str | int | float | bool):
            raise TypeError(f"{what}: {v!r} is not a scalar")
    kinds, exprs = dtypes(df), {}
    for c in columns:
        kind, pairs, on_null = kinds[c], [], ...
        for old, new in mapping.items():
            if old is None:
                on_null = new
            elif (kind == "string") == isinstance(old, str) and (kind == "bool") == isinstance(old, bool):
                pairs.append((old, new))
        news = [n for _, n in pairs] + ([on_null] if on_null is not ... else [])
        fits = all(n is None or _fits(n, kind) for n in news)
        if not news:
            continue
        to = df.schema[c].dataType if fits else T.StringType()
        cell = quoted(c) if fits else text.python_text(quoted(c), kind)
        lit = lambda v, to=to: F.lit(v if to != T.StringType() or v is None else str(v)).cast(to)
        out = None
        for old, new in pairs:
            match = quoted(c) == F.lit(old)
            out = F.when(match, lit(new)) if out is None else out.when(match, lit(new))
        if on_null is not ...:
            out = F.when(quoted(c).isNull(), lit(on_null)) if out is None else out.when(quoted(c).isNull(), lit(on_null))
        exprs[c] = out.otherwise(cell)
    return with_exprs(df, exprs)


def _fits(value, kind: str) -> bool:
    try:
        literal(value, kind, "")
    except ValueError:
        return False
    return True


def map_values(df: DataFrame, mapping: dict, subset=None) -> DataFrame:
    """Values replaced by a mapping; what it doesn't name stays. The key None stands for null.

    Keys apply to columns of their type. New values of another type make the
    column text.
    """
    return _mapped(df, mapping, names(df, subset, "map_values"), "map_values")


def replace_values(df: DataFrame, mapping: dict, column: str | None = None) -> DataFrame:
    """``map_values`` on one column, or on all."""
    return _mapped(df, mapping, names(df, None if column is None else [column], "replace_values"), "replace_values")


def _bound(value, what: str):
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise TypeError(f"{what}: bounds must be numbers")
    if not math.isfinite(value):
        raise ValueError(f"{what}: bounds must be finite")
    return value


def clip_numeric(df: DataFrame, *, lower=None, upper=None, subset=None) -> DataFrame:
    """Numbers brought within bounds; nulls stay. int64 columns need whole bounds."""
    lower, upper = _bound(lower, "clip_numeric"), _bound(upper, "clip_numeric")
    if lower is None and upper is None:
        raise ValueError("clip_numeric: no bound given")
    if lower is not None and upper is not None and lower > upper:
        raise ValueError("clip_numeric: lower exceeds upper")
    columns = [c for c in df.columns if is_number(df, c)] if subset is None else clip_bounds(df, names(df, subset, "clip_numeric"), "clip_numeric")
    kinds, exprs = dtypes(df), {}
    for c in columns:
        lo, hi = (None if b is None else F.lit(literal(b, kinds[c], "clip_numeric")).cast(df.schema[c].dataType) for b in (lower, upper))
        out = quoted(c)
        if hi is not None:
            out = F.when(quoted(c) > hi, hi).otherwise(out)
        if lo is not None:
            out = F.when(quoted(c) < lo, lo).otherwise(out)
        exprs[c] = out
    return with_exprs(df, exprs)


def _finite(c: Column) -> Column:
    return F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double"))


def winsorize_outliers(df: DataFrame, *, lower: float = 0.05, upper: float = 0.95, subset=None, approximate: bool = False) -> DataFrame:
    """Numbers clipped to two of their quantiles (linear interpolation), as float64.

    A few passes of counting find the quantiles of all the columns.
    ``approximate`` uses a mergeable sketch, and one aggregate, instead of exact
    order statistics.
    """
    if not (isinstance(lower, int | float) and isinstance(upper, int | float) and 0 <= lower < upper <= 1):
        raise ValueError("winsorize_outliers: need 0 <= lower < upper <= 1")
    columns = [c for c in df.columns if is_number(df, c)] if subset is None else clip_bounds(df, names(df, subset, "winsorize_outliers"), "winsorize_outliers")
    if not columns:
        return df
    at = [float(lower), float(upper)]
    cells = [_finite(quoted(c)) for c in columns]
    if approximate:
        found = df.agg(*[F.percentile_approx(x, F.array(*map(F.lit, at)), 10000).alias(f"q{i}") for i, x in enumerate(cells)]).first()
    else:
        found = quantiles(df, cells, at)
    exprs = {}
    for c, q in zip(columns, found, strict=True):
        v = quoted(c).cast("double")
        exprs[c] = v if not q else F.when(v < q[0], F.lit(q[0])).when(v > q[1], F.lit(q[1])).otherwise(v)
    return with_exprs(df, exprs)


def normalize_minmax(df: DataFrame, *, subset=None) -> DataFrame:
    """Numbers scaled to [0, 1] by their column's finite range, as float64; a constant column becomes 0."""
    columns = [c for c in df.columns if is_number(df, c)] if subset is None else clip_bounds(df, names(df, subset, "normalize_minmax"), "normalize_minmax")
    if not columns:
        return df
    found = df.agg(*[f(_finite(quoted(c))).alias(f"{f.__name__}{i}") for i, c in enumerate(columns) for f in (F.min, F.max)]).first()
    exprs = {}
    for i, c in enumerate(columns):
        lo, hi = found[2 * i], found[2 * i + 1]
        v = quoted(c).cast("double")
        exprs[c] = v if lo is None else F.when(v.isNotNull(), F.lit(0.0)) if lo == hi else (v - lo) / (hi - lo)
    return with_exprs(df, exprs)


def round_numeric_columns(df: DataFrame, *, subset=None, decimals: int = 0) -> DataFrame:
    """Numbers rounded half to even; columns that aren't numeric stay."""
    if isinstance(decimals, bool) or not isinstance(decimals, int):
        raise TypeError("round_numeric_columns: decimals must be an integer")
    kinds = dtypes(df)
    chosen = [c for c in names(df, subset, "round_numeric_columns") if kinds[c] in ("int64", "float64")]
    return with_exprs(df, {c: F.bround(quoted(c), decimals).cast(df.schema[c].dataType) for c in chosen if kinds[c] == "float64" or decimals < 0})


def collapse_rare_categories(df: DataFrame, column: str, threshold: float = 0.02, fill_value: str = "Other") -> DataFrame:
    """Text values with a share of the non-null cells below the threshold replaced; nulls stay.

    The frequent values, at most 1 / threshold of them, come from one aggregate
    and go back as a literal list, so the frame isn't shuffled.
    """
    require(df, [column], "collapse_rare_categories")
    if not is_text(df, column):
        raise TypeError("collapse_rare_categories: the column must be text")
    if isinstance(threshold, bool) or not isinstance(threshold, int | float) or not 0 <= threshold <= 1:
        raise ValueError("collapse_rare_categories: threshold must be within 0 and 1")
    if threshold == 0:
        return df
    c = quoted(column)
    counts = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.persist()
    try:
        n = counts.agg(F.sum("n")).first()[0] or 0
        common = [r.v for r in counts.where(F.col("n") / F.lit(max(n, 1)) >= threshold).select("v").collect()]
    finally:
        counts.unpersist()
    return with_exprs(df, {column: F.when(c.isNull() | c.isin(common), c).otherwise(F.lit(fill_value))})


def safe_divide_columns(df: DataFrame, numerator: str, denominator: str, output_column: str, fill_value: float = 0.0) -> DataFrame:
    """A quotient as float64; a null on either side or a zero below gives the fill value."""
    require(df, [numerator, denominator], "safe_divide_columns")
    for c in (numerator, denominator):
        if not is_number(df, c):
            raise ValueError(f"safe_divide_columns: {c!r} is not numeric")
    if output_column in df.columns:
        warnings.warn(f"safe_divide_columns: {output_column!r} is overwritten", UserWarning, stacklevel=2)
    value = F.coalesce(F.try_divide(quoted(numerator).cast("double"), quoted(denominator).cast("double")), F.lit(float(fill_value)))
    return with_exprs(df, {output_column: value}) if output_column in df.columns else df.withColumn(output_column, value)
