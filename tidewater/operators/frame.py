"""What a frame is like: shape, types, summary statistics, and a wrapper with these as methods."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.types import canonical, dtypes, quoted, require
from tidewater.operators import columns as C
from tidewater.operators import rows as R


@dataclass(frozen=True)
class ColumnSummary:
    name: str
    dtype: str
    nullable: bool


def schema_summary(df: DataFrame) -> list[ColumnSummary]:
    """Name, type, and whether a null occurs, for each column; one aggregate."""
    if not df.columns:
        return []
    nulls = df.agg(*[F.max(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return [ColumnSummary(c, k, bool(n)) for (c, k), n in zip(dtypes(df).items(), nulls, strict=True)]


def describe(df: DataFrame) -> dict[str, dict[str, Any]]:
    """Statistics of every column from one aggregate.

    Numbers: count (not null), nulls, non_finite, and mean, min and max of the
    finite values (0.0 without any). Bools: count, nulls, true, false,
    true_ratio. Text: count, nulls, unique.
    """
    rows = describe_frame(df).collect()
    return {r["column"]: {k: v for k, v in r.asDict().items() if v is not None and k not in ("column", "dtype")} for r in rows}


def describe_frame(df: DataFrame) -> DataFrame:
    """``describe`` as a frame with one row per column."""
    kinds, parts = dtypes(df), []
    for c in df.columns:
        v, kind = quoted(c), kinds[c]
        one: dict[str, Any] = {"count": F.count(v), "nulls": F.count_if(v.isNull())}
        if kind in ("int64", "float64"):
            finite = F.when(F.abs(v.cast("double")) < float("inf"), v.cast("double"))
            one["non_finite"] = F.count_if(v.isNotNull() & finite.isNull())
            one |= {n: F.coalesce(f(finite), F.lit(0.0)) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))}
        elif kind == "bool":
            one |= {"true": F.count_if(v), "false": F.count_if(~v), "true_ratio": F.coalesce(F.try_divide(F.count_if(v), F.count(v)), F.lit(0.0))}
        else:
            one["unique"] = F.count_distinct(v)
        full = [one.get(n, F.lit(None)).cast(k).alias(n) for n, k in _DESCRIBED]
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), *full))
    return df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("d")).select("d.*")


_DESCRIBED = [("count", "long"), ("nulls", "long"), ("non_finite", "long"), ("mean", "double"), ("min", "double"), ("max", "double"), ("true", "long"), ("false", "long"), ("true_ratio", "double"), ("unique", "long")]


def memory_usage(df: DataFrame, deep: bool = False):
    """Estimated bytes: the widths of the types, a byte per null mark, and with text its UTF-8 length plus 8 of offset.

    With ``deep``, a dict by column.
    """
    kinds = dtypes(df)
    width = {"int64": 8, "float64": 8, "bool": 1}
    sums = df.agg(F.count(F.lit(1)), *[F.sum(F.coalesce(F.octet_length(quoted(c)), F.lit(0))) if kinds[c] == "string" else F.lit(0) for c in df.columns]).first()
    n = sums[0]
    each = {c: n * (1 + (width.get(kinds[c], 8))) + (s or 0) for c, s in zip(df.columns, sums[1:], strict=True)}
    return each if deep else sum(each.values())


def compare_schema(df: DataFrame, other: DataFrame, strict: bool = False) -> bool:
    """Whether two frames have the same columns and types; ``strict`` asks for the same order too."""
    a, b = dtypes(df), dtypes(other)
    return list(a.items()) == list(b.items()) if strict else a == b


def preview(df: DataFrame, n: int = 5) -> str:
    """A text table of the first n rows."""
    rows = R.head(df, n).collect()
    table = [list(df.columns)] + [["null" if v is None else str(v) for v in r] for r in rows]
    wide = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in table]
    return "\n".join([lines[0], "-+-".join("-" * w for w in wide), *lines[1:]])


class Frame:
    """A thin wrapper with methods; every operator also takes the plain frame, ``.df``."""

    def __init__(self, df: DataFrame, attrs: dict | None = None):
        self.df, self.attrs = df, dict(attrs or {})

    @property
    def columns(self) -> list[str]:
        return list(self.df.columns)

    @property
    def dtypes(self) -> dict[str, str]:
        return dtypes(self.df)

    @property
    def row_count(self) -> int:
        return self.df.count()

    @property
    def column_count(self) -> int:
        return len(self.df.columns)

    @property
    def shape(self) -> tuple[int, int]:
        return self.row_count, self.column_count

    @property
    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def __len__(self) -> int:
        return self.row_count

    def __getitem__(self, key):
        """A column's values as a list, or a frame of several columns."""
        if isinstance(key, str):
            require(self.df, [key], "frame", KeyError)
            return [r[0] for r in self.df.select(quoted(key)).collect()]
        if isinstance(key, list) and all(isinstance(k, str) for k in key):
            require(self.df, key, "frame", KeyError)
            return Frame(self.df.select(*map(quoted, key)), self.attrs)
        raise TypeError("a frame is indexed by a column's name or a list of names")

    def _new(self, df: DataFrame) -> Frame:
        return Frame(df, self.attrs)

    def head(self, n: int = 5) -> Frame:
        return self._new(R.head(self.df, n))

    def tail(self, n: int = 5) -> Frame:
        return self._new(R.tail(self.df, n))

    def preview(self, n: int = 5) -> str:
        return preview(self.df, n)

    def select_columns(self, columns) -> Frame:
        return self._new(C.select_columns(self.df, columns))

    def drop_columns(self, columns) -> Frame:
        """As the function, but a name may come twice and all columns may go."""
        gone = [columns] if isinstance(columns, str) else list(columns)
        require(self.df, gone, "drop_columns", KeyError)
        return self._new(self.df.select(*[quoted(c) for c in self.df.columns if c not in set(gone)]))

    def select_dtypes(self, include=None, exclude=None) -> Frame:
        return self._new(C.select_dtypes(self.df, include, exclude))

    def astype(self, dtype) -> Frame:
        """Cast by one type for all columns or a mapping."""
        from tidewater.operators.values import cast_types

        mapping = dtype if isinstance(dtype, dict) else dict.fromkeys(self.df.columns, dtype)
        return self._new(cast_types(self.df, {c: canonical(t) for c, t in mapping.items()}))

    def describe(self) -> dict:
        return describe(self.df)

    def schema_summary(self) -> list[ColumnSummary]:
        return schema_summary(self.df)

    def memory_usage(self, deep: bool = False):
        return memory_usage(self.df, deep)

    def compare_schema(self, other, strict: bool = False) -> bool:
        return compare_schema(self.df, getattr(other, "df", other), strict)

    def pipe(self, function, *args, **kwargs) -> Frame:
        return self._new(function(self.df, *args, **kwargs))

    def to_pandas(self):
        from tidewater.sources.memory import to_pandas

        return to_pandas(self.df)

    def to_dict(self, orient: str = "list"):
        from tidewater.sources.memory import to_dict

        return to_dict(self.df, orient)

    def to_numpy(self, fill_value=None):
        from tidewater.sources.memory import to_numpy

        return to_numpy(self.df, fill_value)

    def to_arrow(self):
        return self.df.toArrow()

