"""The flat type system: string, int64, float64 and bool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = {T.StringType: "string", T.LongType: "int64", T.DoubleType: "float64", T.BooleanType: "bool", T.NullType: "null"}
SPARK = {"string": T.StringType(), "int64": T.LongType(), "float64": T.DoubleType(), "bool": T.BooleanType()}
ALIASES = {
    "str": "string", "string": "string", "object": "string", "int": "int64", "int64": "int64", "integer": "int64", "long": "int64",
    "float": "float64", "float64": "float64", "double": "float64", "bool": "bool", "boolean": "bool",
}
_WIDER = {T.ByteType: "int64", T.ShortType: "int64", T.IntegerType: "int64", T.FloatType: "float64", T.DecimalType: "float64", T.VarcharType: "string", T.CharType: "string"}


def quoted(name: str):
    """A column by its very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_name(kind: T.DataType) -> str:
    """The flat type of a Spark type; narrower ones count as what they widen to, others keep Spark's name."""
    return NAMES.get(type(kind)) or _WIDER.get(type(kind)) or kind.simpleString()


def dtypes(df: DataFrame) -> dict[str, str]:
    return {f.name: type_name(f.dataType) for f in df.schema.fields}


def canonical(name) -> str:
    """The flat type that a name or Python type stands for."""
    key = name if isinstance(name, str) else getattr(name, "__name__", str(name))
    found = ALIASES.get(key.lower())
    if not found:
        raise ValueError(f"unsupported type {name!r}; use string, int64, float64 or bool")
    return found


def flat(df: DataFrame, widen: bool = False) -> DataFrame:
    """The frame in flat types: ints and floats widened, nested types refused.

    With ``widen``, decimals become float64, and dates and timestamps ISO text;
    without it they are refused like nested ones.
    """
    out, refused = [], []
    for f in df.schema.fields:
        c, kind = quoted(f.name), f.dataType
        if type(kind) in NAMES:
            out.append(c)
        elif isinstance(kind, T.ByteType | T.ShortType | T.IntegerType):
            out.append(c.cast("long").alias(f.name))
        elif isinstance(kind, T.FloatType) or (widen and isinstance(kind, T.DecimalType)):
            out.append(c.cast("double").alias(f.name))
        elif isinstance(kind, T.VarcharType | T.CharType):
            out.append(c.cast("string").alias(f.name))
        elif widen and isinstance(kind, T.DateType):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif widen and isinstance(kind, T.TimestampType | T.TimestampNTZType):
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name))
        else:
            refused.append(f"{f.name}: {kind.simpleString()}")
    if refused:
        raise TypeError("not a flat column: " + ", ".join(refused))
    return df.select(*out)


def names(df: DataFrame, subset, operation: str, empty_ok: bool = False) -> list[str]:
    """The columns of a subset, checked: each exists and comes once; None means all."""
    if subset is None:
        return list(df.columns)
    if isinstance(subset, str) or not hasattr(subset, "__iter__"):
        raise TypeError(f"{operation}: columns must be given as a list of names")
    out = list(subset)
    if any(not isinstance(c, str) for c in out):
        raise TypeError(f"{operation}: column names must be strings")
    if not out and not empty_ok:
        raise ValueError(f"{operation}: no columns given")
    require(df, out, operation)
    if len(set(out)) < len(out):
        raise ValueError(f"{operation}: a column is named twice")
    return out


def require(df: DataFrame, wanted, operation: str, error: type[Exception] = ValueError) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise error(f"{operation}: no column {', '.join(map(repr, missing))}; there are {', '.join(map(repr, df.columns))}")


def is_text(df: DataFrame, name: str) -> bool:
    return dtypes(df)[name] == "string"


def is_number(df: DataFrame, name: str) -> bool:
    return dtypes(df)[name] in ("int64", "float64")


def with_exprs(df: DataFrame, exprs: dict) -> DataFrame:
    """The frame with some columns replaced in their places, in one projection."""
    return df.select(*[exprs[c].alias(c) if c in exprs else quoted(c) for c in df.columns])


def renamed(df: DataFrame, new: list[str], operation: str) -> DataFrame:
    """The frame under new names, which must be distinct and not empty."""
    if any(not n for n in new):
        raise ValueError(f"{operation}: a name would be empty")
    twice = sorted({n for n in new if new.count(n) > 1})
    if twice:
        raise ValueError(f"{operation}: names would repeat: {', '.join(twice)}")
    return df.toDF(*new)
