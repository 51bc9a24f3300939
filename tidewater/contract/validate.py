"""Validation: a contract compiled to expressions over one scan.

Every rule of every field becomes a predicate; a row's broken rules are one
array, exploded to issues. Uniqueness adds one windowed count per unique column.
Only values that no JVM expression can judge (custom validators, IPv6, free-form
timestamps, patterns without a Java form) go through a pandas UDF.
"""

from __future__ import annotations

import ipaddress
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.contract import codes
from tidewater.contract.schema import Field, Schema, validator
from tidewater.errors import SchemaValidationError
from tidewater.functions import regexes, text
from tidewater.functions.types import dtypes, quoted
from tidewater.operators.rowid import ROW, with_row_id
from tidewater.operators.values import cast_text

ISSUE = "column string, rule string, message string, row_index long, value string, severity string"
ISSUE_COLUMNS = ["column", "rule", "message", "row_index", "value", "severity"]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PATTERNS = {
    "email": r"[^@\s]+@[^@\s]+\.[^@\s]+",
    "email:strict": r"[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "url": r"https?://\S+",
    "phone": r"\+?[0-9][0-9 .()\-]{6,}[0-9]",
    "ipv4": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "mac_address": r"[0-9a-fA-F]{2}(?:(?::[0-9a-fA-F]{2}){5}|(?:-[0-9a-fA-F]{2}){5})",
}
_SETS = {"country_code": (lambda: codes.COUNTRIES, str.upper), "language_code": (lambda: codes.LANGUAGES, str.lower), "currency_code": (lambda: codes.CURRENCIES, str.upper), "timezone": (codes.timezones, None)}
_STRPTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "p": "a", "I": "hh", "j": "DDD", "z": "xx", "f": "SSSSSS", "%": "%"}


@dataclass(frozen=True)
class ValidationIssue:
    column: str | None
    rule: str
    message: str
    row_index: int | None = None
    value: Any = None
    severity: str = "error"

    def to_dict(self) -> dict:
        return {c: getattr(self, c) for c in ISSUE_COLUMNS}


class ValidationResult:
    """Issues, in the order of fields, rules and rows. ``frame`` has them undivided, for contracts broken by many rows."""

    def __init__(self, issues: list[ValidationIssue], row_count: int | None, frame: DataFrame | None = None, truncated: bool = False):
        self.issues, self.row_count, self.frame, self.truncated = issues, row_count, frame, truncated

    @property
    def passed(self) -> bool:
        return not any(i.severity == "error" for i in self.issues)

    @property
    def issue_count(self) -> int:
        return len(self.issues)

    @property
    def bad_rows(self) -> list[int]:
        return sorted({i.row_index for i in self.issues if i.row_index is not None})

    def summary(self) -> dict:
        by: dict[str, dict[str, int]] = {"issues_by_rule": {}, "issues_by_column": {}, "issues_by_severity": {}}
        for i in self.issues:
            for key, v in (("issues_by_rule", i.rule), ("issues_by_column", i.column or ""), ("issues_by_severity", i.severity)):
                by[key][v] = by[key].get(v, 0) + 1
        return {"passed": self.passed, "row_count": self.row_count, "issue_count": self.issue_count, "bad_row_count": len(self.bad_rows), "truncated": self.truncated, **by}

    def to_dict(self) -> dict:
        return self.summary() | {"issues": [i.to_dict() for i in self.issues]}

    def to_pandas(self) -> pd.DataFrame:
        return pd.DataFrame([i.to_dict() for i in self.issues], columns=ISSUE_COLUMNS)

    def to_markdown(self, *, max_issues: int | None = None, redact_values: bool = False, output=None) -> str:
        from tidewater.quality.profile import REDACTED, _cell, _emit

        lines = [f"# Validation: {'passed' if self.passed else 'failed'}", "", f"{self.issue_count} issues", ""]
        shown = self.issues if max_issues is None else self.issues[:max_issues]
        if shown:
            lines += ["| column | rule | row | value | message |", "|---|---|---|---|---|"]
            lines += [f"| {_cell(i.column or '-')} | {i.rule} | {i.row_index if i.row_index is not None else '-'} | {REDACTED if redact_values and i.value is not None else _cell(i.value)} | {_cell(i.rule if redact_values else i.message)} |" for i in shown]
        return _emit("\n".join(lines) + "\n", output)

    def raise_for_errors(self) -> ValidationResult:
        if not self.passed:
            bad = [i for i in self.issues if i.severity == "error"]
            raise SchemaValidationError(f"{len(bad)} errors, first: {bad[0].message}", self)
        return self


@dataclass
class _Rule:
    """A predicate that is true where the rule is broken."""

    name: str
    broken: Column
    message: str
    whole: bool = False  # one issue for the column, without a row


def _judge(f, kind: str = "boolean"):
    """A pandas UDF that is true where f(value) is false or fails; nulls pass."""

    @F.pandas_udf(kind)
    def bad(s: pd.Series) -> pd.Series:
        known: dict = {}

        def one(v) -> bool:
            if v is None or v != v:
                return False
            if v not in known:
                try:
                    known[v] = not f(v)
                except Exception:
                    known[v] = True
            return known[v]

        return pd.Series([one(v) for v in s], dtype=bool)

    return bad


def _matches(c: Column, pattern: str) -> Column:
    """True where the text doesn't match as a whole."""
    java = regexes.full(pattern)
    if java is not None:
        return ~c.rlike(java)
    compiled = re.compile(pattern)
    return _judge(lambda v: compiled.fullmatch(v) is not None)(c)


def _uuid_ok(version: int | None):
    return lambda v: (u := uuid.UUID(v)) and (version is None or u.version == version)


def _ip_ok(version: int | None):
    return lambda v: ipaddress.ip_address(v).version == version if version else bool(ipaddress.ip_address(v))


def _semantic(f: Field, c: Column) -> Column | None:
    """True where the value isn't of the semantic type; None for an unknown type."""
    s, _, arg = f.semantic.partition(":")
    if f.semantic in _PATTERNS:
        return _matches(c, _PATTERNS[f.semantic])
    if s == "url" and arg:
        schemes = "|".join(re.escape(x) for x in arg.split(","))
        return ~c.rlike(rf"(?i)\A(?:{schemes})://\S+\z")
    if s in _SETS:
        values, fold = _SETS[s]
        if f.case_sensitive or fold is None:
            known = values() if f.case_sensitive else {v.lower() for v in values()}
            return ~(c if f.case_sensitive else F.lower(c)).isin(sorted(known))
        return ~(F.upper(c) if fold is str.upper else F.lower(c)).isin(sorted(values()))
    if s == "uuid" and (not arg or arg.isdigit()):
        canonical = rf"\A[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-{arg or '[0-9a-fA-F]'}[0-9a-fA-F]{{3}}-{'[89abAB]' if arg else '[0-9a-fA-F]'}[0-9a-fA-F]{{3}}-[0-9a-fA-F]{{12}}\z"
        return F.when(c.rlike(canonical), F.lit(False)).otherwise(_judge(_uuid_ok(int(arg) if arg else None))(F.when(~c.rlike(canonical), c)))
    if s == "ip_address" and arg in ("", "4", "6"):
        v4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"
        rest = F.when(~c.rlike(v4), c)
        return F.when(c.rlike(v4), F.lit(arg == "6")).otherwise(_judge(_ip_ok(int(arg) if arg else None))(rest)) if arg != "4" else ~c.rlike(v4)
    if s == "credit_card":
        digits = F.regexp_replace(c, r"[ \-]", "")
        return ~(c.rlike(r"\A[0-9][0-9 \-]{10,}[0-9]\z") & F.length(digits).between(12, 19) & F.call_function("luhn_check", digits))
    if s == "date":
        return ~c.rlike(r"\A\d{4}-\d{2}-\d{2}\z") | F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNull()
    return None


def _java_format(fmt: str) -> str | None:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            to = _STRPTIME.get(fmt[i + 1 : i + 2])
            if to is None:
                return None
            out, i = out + to, i + 2
        else:
            out, i = out + (f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]), i + 1
    return out


_AWARE = r"(?:Z|[+-]\d{2}:?\d{2})$"


def _moment(f: Field, c: Column) -> Column:
    """The instant of a text in microseconds, null where it isn't one; naive texts count as UTC."""
    java = _java_format(f.format) if f.format else None
    if java:
        return F.unix_micros(F.try_to_timestamp(c, F.lit(java)))
    fmt = f.format

    @F.pandas_udf("long")
    def parse(s: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            try:
                t = pd.to_datetime(v, format=fmt) if fmt else pd.Timestamp(v)
            except (ValueError, OverflowError, TypeError):
                return None
            return None if t is pd.NaT else (t.tz_localize("UTC") if t.tzinfo is None else t).value // 1000

        return pd.Series([one(v) for v in s], dtype="Int64")

    return parse(c)


def _instant(v) -> tuple[int, bool]:
    t = pd.Timestamp(v)
    return (t.tz_localize("UTC") if t.tzinfo is None else t).value // 1000, t.tzinfo is not None


def _rules(name: str, f: Field, kinds: dict[str, str], unique_count: Column | None, aware: tuple[bool, bool] | None) -> list[_Rule]:
    """The rules of a field in the order in which their issues are reported."""
    c, kind = quoted(name), kinds[name]
    expected = "string" if f.dtype == "datetime" else f.dtype
    if expected is not None and kind != expected:
        return [_Rule("dtype", F.lit(True), f"{name}: expected {f.dtype}, found {kind}", whole=True)]
    null = c.isNull() | (F.isnan(c) if kind == "float64" else F.lit(False))
    empty = null | (text.strip_unicode(c) == "") if kind == "string" else null
    some = ~null
    out = []
    if not f.nullable:
        out.append(_Rule("nullable", empty, f"{name}: must not be null"))
    if f.required_if is not None and f.required_if[0] in kinds:
        other, value = f.required_if
        when = text.python_text(quoted(other), kinds[other]) == str(value) if kinds[other] != "string" or not isinstance(value, str) else quoted(other) == value
        out.append(_Rule("required_if", when & empty, f"{name}: required where {other} is {value}"))
    if unique_count is not None:
        out.append(_Rule("unique", some & (unique_count > 1), f"{name}: value repeats"))
    if f.allowed is not None:
        if kind == "string" and not f.case_sensitive:
            out.append(_Rule("allowed", some & ~F.lower(c).isin(sorted(str(v).lower() for v in f.allowed)), f"{name}: value is not allowed"))
        else:
            fits = [v for v in f.allowed if (kind == "string") == isinstance(v, str) and (kind == "bool") == isinstance(v, bool)]
            out.append(_Rule("allowed", some & ~(c.isin(sorted(fits)) if fits else F.lit(False)), f"{name}: value is not allowed"))
    if f.dtype == "datetime":
        at = _moment(f, c)
        out.append(_Rule("format", some & at.isNull(), f"{name}: not a timestamp" + (f" of the form {f.format}" if f.format else "")))
        if aware == (True, True):
            out.append(_Rule("timezone", some & at.isNotNull(), f"{name}: values with and without a time zone are mixed"))
        else:
            for rule, bound, worse in (("min", f.min, lambda b: at < b), ("max", f.max, lambda b: at > b)):
                if bound is not None:
                    limit, zone = _instant(bound)
                    if aware and zone != aware[0] and any(aware):
                        out.append(_Rule("timezone", some & at.isNotNull(), f"{name}: the bound {bound} and the values don't both have a time zone"))
                    else:
                        out.append(_Rule(rule, some & worse(limit), f"{name}: {'before' if rule == 'min' else 'after'} {bound}"))
    elif f.semantic != "date" and (f.min is not None or f.max is not None):
        number = c if kind in ("int64", "float64") else cast_text(c, "float64") if kind == "string" else c.cast("double")
        if kind == "string":
            out.append(_Rule("numeric", some & number.isNull(), f"{name}: not a number"))
        if f.min is not None:
            out.append(_Rule("min", some & (number < f.min), f"{name}: below {f.min}"))
        if f.max is not None:
            out.append(_Rule("max", some & (number > f.max), f"{name}: above {f.max}"))
    if f.pattern is not None and kind == "string":
        out.append(_Rule("pattern", some & _matches(c, f.pattern), f"{name}: doesn't match {f.pattern}"))
    if f.custom is not None:
        fn = validator(f.custom)
        if fn is None:
            out.append(_Rule("custom", F.lit(True), f"{name}: no validator {f.custom!r} is registered", whole=True))
        else:
            out.append(_Rule("custom", some & _judge(fn)(c), f"{name}: refused by {f.custom}"))
    if f.semantic is not None:
        bad = _semantic(f, c) if kind == "string" else None
        if bad is None:
            out.append(_Rule("semantic", F.lit(True), f"{name}: unknown semantic type {f.semantic!r}", whole=True))
        else:
            rule = f.semantic.partition(":")[0]
            out.append(_Rule(rule, some & bad, f"{name}: not a valid {rule}"))
            if f.semantic == "date":
                for r, bound, worse in (("min", f.min, lambda b: c < b), ("max", f.max, lambda b: c > b)):
                    if bound is not None:
                        out.append(_Rule(r, some & ~bad & worse(str(bound)[:10]), f"{name}: {'before' if r == 'min' else 'after'} {bound}"))
    if kind == "string":
        if f.min_length is not None:
            out.append(_Rule("min_length", some & (F.length(c) < f.min_length), f"{name}: shorter than {f.min_length}"))
        if f.max_length is not None:
            out.append(_Rule("max_length", some & (F.length(c) > f.max_length), f"{name}: longer than {f.max_length}"))
    return out


def _dtype_hint(df: DataFrame, names: list[str], schema: Schema) -> dict[str, str]:
    """For text columns of a wrong type: a hint where every value could be cast. One aggregate."""
    checks = {n: cast_text(quoted(n), schema.fields[n].dtype) for n in names if schema.fields[n].dtype in ("int64", "float64", "bool")}
    if not checks:
        return {}
    found = df.agg(*[F.count_if(quoted(n).isNotNull() & x.isNull()).alias(f"c{i}") for i, (n, x) in enumerate(checks.items())]).first()
    return {n: f"; all its values can be cast to {schema.fields[n].dtype}" for n, bad in zip(checks, found, strict=True) if not bad}


def _plain_issues(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ISSUE + ", f int, r int")


def issues(df: DataFrame, schema: Schema, *, row_id: str | None = None, order_by=None) -> DataFrame:
    """All issues as a frame, with ``f`` and ``r``, the places of field and rule, for their order.

    ``row_id`` names a column to take for ``row_index``; else rows are numbered
    from 1.
    """
    spark, kinds = df.sparkSession, dtypes(df)
    driver: list[tuple] = []
    wrong = [n for n, f in schema.fields.items() if n in kinds and f.dtype and kinds[n] == "string" and f.dtype not in ("string", "datetime")]
    hints = _dtype_hint(df, wrong, schema) if wrong else {}
    stamps = [n for n, f in schema.fields.items() if f.dtype == "datetime" and kinds.get(n) == "string"]
    aware: dict[str, tuple[bool, bool]] = {}
    if stamps:
        seen = df.agg(*[g for n in stamps for g in (F.count_if(text.strip_unicode(quoted(n)).rlike(_AWARE)), F.count_if(quoted(n).isNotNull() & ~text.strip_unicode(quoted(n)).rlike(_AWARE)))]).first()
        aware = {n: (bool(seen[2 * i]), bool(seen[2 * i + 1])) for i, n in enumerate(stamps)}
    rows = df if row_id else with_row_id(df, order_by)
    index = quoted(row_id).cast("long") if row_id else F.col(ROW) + 1
    for k, (n, f) in enumerate(schema.fields.items()):
        if f.unique and n in kinds:
            some = quoted(n).isNotNull()
            rows = rows.withColumn(f"__unique{k}", F.count(F.when(some, 1)).over(Window.partitionBy(quoted(n), F.when(~some, index))))
    found = []
    for k, (n, f) in enumerate(schema.fields.items()):
        if n not in kinds:
            driver.append((n, "required_column", f"{n}: the column is missing", None, None, f.severity, k, 0))
            continue
        for r, rule in enumerate(_rules(n, f, kinds, F.col(f"__unique{k}") if f.unique else None, aware.get(n))):
            if rule.whole:
                driver.append((n, rule.name, rule.message + hints.get(n, "") * (rule.name == "dtype"), None, None, f.severity, k, r))
            else:
                found.append((F.coalesce(rule.broken, F.lit(False)), n, rule.name, rule.message, f.severity, k, r))
    last = len(schema.fields)
    if schema.strict:
        driver += [(n, "unexpected_column", f"{n}: the column is not in the schema", None, None, "error", last, i) for i, n in enumerate(c for c in kinds if c not in schema.fields and c != row_id)]
    if schema.unique:
        keys = list(schema.unique)
        missing = [c for c in keys if c not in kinds]
        driver += [(c, "composite_unique", f"{c}: a column of the key is missing", None, None, "error", last + 1, i) for i, c in enumerate(missing)]
        if not missing:
            rows = rows.withColumn("__key", F.count(F.lit(1)).over(Window.partitionBy(*map(quoted, keys))))
            label = ",".join(keys)
            found.append((F.col("__key") > 1, label, "composite_unique", f"{label}: the key repeats", "error", last + 1, 0))
    out = _plain_issues(spark, driver)
    if found:
        structs = []
        for broken, n, rule, message, severity, k, r in found:
            value = F.concat_ws(",", *[F.coalesce(quoted(c).cast("string"), F.lit("null")) for c in schema.unique]) if rule == "composite_unique" else text.python_text(quoted(n), kinds[n])
            structs.append(F.when(broken, F.struct(F.lit(n).alias("column"), F.lit(rule).alias("rule"), F.lit(message).alias("message"), index.alias("row_index"), value.alias("value"), F.lit(severity).alias("severity"), F.lit(k).alias("f"), F.lit(r).alias("r"))))
        broken = rows.select(F.explode(F.array_compact(F.array(*structs))).alias("i")).select("i.*")
        out = broken if not driver else out.unionByName(broken)
    for i, rule in enumerate(schema.rules or ()):
        try:
            extra = rule(df)
        except KeyError as error:
            out = out.unionByName(_plain_issues(spark, [(str(error.args[0]) if error.args else None, "missing_column", f"a rule needs the column {error}", None, None, "error", last + 2, i)]))
            continue
        if not isinstance(extra, DataFrame):
            extra = spark.createDataFrame([tuple(x.to_dict()[c] if c != "value" or x.value is None else str(x.value) for c in ISSUE_COLUMNS) for x in extra or ()], ISSUE)
        out = out.unionByName(extra.select(*ISSUE_COLUMNS).withColumns({"f": F.lit(last + 2), "r": F.lit(i)}))
    return out


def validate(df: DataFrame, schema, max_errors: int | None = None, *, order_by=None, row_id: str | None = None) -> ValidationResult:
    """Checks a frame against a contract and collects at most ``max_errors`` issues, first fields and rules first.

    ``schema`` may be a dict of fields. The result's ``frame`` has all issues and
    stays distributed.
    """
    schema = schema if isinstance(schema, Schema) else Schema(dict(schema))
    if max_errors is not None and (isinstance(max_errors, bool) or not isinstance(max_errors, int) or max_errors < 1):
        raise ValueError("validate: max_errors must be a positive integer")
    every = issues(df, schema, order_by=order_by, row_id=row_id)
    ordered = every.orderBy("f", "r", F.col("row_index").asc_nulls_first())
    got = (ordered.limit(max_errors + 1) if max_errors is not None else ordered).collect()
    cut = max_errors is not None and len(got) > max_errors
    out = [ValidationIssue(*(x[c] for c in ISSUE_COLUMNS)) for x in (got[:max_errors] if cut else got)]
    return ValidationResult(out, df.count(), every.select(*ISSUE_COLUMNS), cut)


def validate_chunked(chunks: Iterable[DataFrame], schema, *, max_errors: int | None = None) -> ValidationResult:
    """Chunk after chunk, rows numbered through; uniqueness is judged within a chunk. Stops at ``max_errors``."""
    out: list[ValidationIssue] = []
    rows, cut = 0, False
    for chunk in chunks:
        left = None if max_errors is None else max_errors - len(out)
        if left is not None and left <= 0:
            cut = True
            break
        got = validate(chunk, schema, left)
        out += [ValidationIssue(i.column, i.rule, i.message, None if i.row_index is None else i.row_index + rows, i.value, i.severity) for i in got.issues]
        rows += got.row_count
        cut = cut or got.truncated
    return ValidationResult(out, rows, None, cut)
