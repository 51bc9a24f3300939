"""Comparison of profiles and frames: changes, drift, gates and differences."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.functions.types import dtypes, quoted
from tidewater.quality.profile import ColumnOutline, ColumnProfile, DataQualityReport, Outline, _cell, _emit, outline, profile


def _report(x) -> DataQualityReport:
    return x if isinstance(x, DataQualityReport) else profile(x)


def _outline(x, duplicates: bool = False) -> DataQualityReport | Outline:
    """A profile as it is; of a frame, no more than what is compared."""
    return x if isinstance(x, DataQualityReport) else outline(x, duplicates)


@dataclass
class ProfileComparison:
    row_count_a: int
    row_count_b: int
    columns: dict[str, dict[str, Any]]

    @property
    def status(self) -> str:
        found = {c["status"] for c in self.columns.values()}
        return "changed" if "changed" in found else "warning" if "warning" in found else "ok"

    def to_dict(self, *, exclude_columns=None) -> dict:
        gone = set(exclude_columns or ())
        return {"row_count_a": self.row_count_a, "row_count_b": self.row_count_b, "status": self.status, "columns": {n: c for n, c in self.columns.items() if n not in gone}}

    def to_json(self, *, indent=None, redact_sample_values: bool = False, exclude_columns=None, output=None) -> str:
        return _emit(json.dumps(self.to_dict(exclude_columns=exclude_columns), indent=indent, default=str), output)

    def to_markdown(self, output=None) -> str:
        lines = ["# Comparison", "", f"rows: {self.row_count_a} and {self.row_count_b}; {self.status}", "", "| column | metric | a | b | status |", "|---|---|---|---|---|"]
        lines += [f"| {_cell(n)} | {m} | {x['a']} | {x['b']} | {x['status']} |" for n, c in self.columns.items() for m, x in c["metrics"].items()]
        return _emit("\n".join(lines) + "\n", output)


def _graded(a, b, warning: float, changed: float) -> dict:
    if a is None or b is None:
        return {"a": a, "b": b, "status": "ok" if a == b else "changed"}
    delta = abs(b - a)
    return {"a": a, "b": b, "delta": b - a, "status": "changed" if delta >= changed else "warning" if delta >= warning else "ok"}


def compare_profiles(profile_a, profile_b) -> ProfileComparison:
    """Metric by metric: ok, warning or changed. Both must have the same columns."""
    a, b = _report(profile_a), _report(profile_b)
    if set(a.columns) != set(b.columns):
        raise ValueError(f"compare_profiles: columns differ: {', '.join(sorted(set(a.columns) ^ set(b.columns)))}")
    out = {}
    for name, x in a.columns.items():
        y = b.columns[name]
        rows = max(x.row_count, y.row_count, 1)
        metrics = {"dtype": {"a": x.dtype, "b": y.dtype, "status": "ok" if x.dtype == y.dtype else "changed"}}
        for m in ("null_ratio", "unique_ratio"):
            metrics[m] = _graded(getattr(x, m), getattr(y, m), 0.1, 0.25)
        metrics["unique_count"] = _graded(x.unique_count, y.unique_count, max(1, 0.1 * rows), max(1, 0.25 * rows))
        if x.dtype == y.dtype and x.dtype in ("int64", "float64"):
            scale = max(abs(v) for v in (x.min, x.max, y.min, y.max, 1e-12) if v is not None)
            for m in ("min", "max", "mean"):
                metrics[m] = _graded(getattr(x, m), getattr(y, m), 0.1 * scale, 0.25 * scale)
        found = {m["status"] for m in metrics.values()}
        out[name] = {"status": "changed" if "changed" in found else "warning" if "warning" in found else "ok", "metrics": metrics}
    return ProfileComparison(a.row_count, b.row_count, out)


@dataclass
class DriftReport:
    added_columns: list[str]
    removed_columns: list[str]
    dtype_changes: dict[str, tuple[str, str]]
    null_ratio_changes: dict[str, tuple[float, float]]
    row_count_old: int
    row_count_new: int

    @property
    def has_drift(self) -> bool:
        return bool(self.added_columns or self.removed_columns or self.dtype_changes or self.null_ratio_changes or self.row_count_old != self.row_count_new)

    def to_dict(self) -> dict:
        return asdict(self) | {"has_drift": self.has_drift}


def detect_drift(old, new) -> DriftReport:
    """What changed from one profile to the next; another number of rows is drift too.

    A frame in a profile's place costs one aggregate.
    """
    a, b = _outline(old), _outline(new)
    both = [n for n in a.columns if n in b.columns]
    return DriftReport(
        [n for n in b.columns if n not in a.columns],
        [n for n in a.columns if n not in b.columns],
        {n: (a.columns[n].dtype, b.columns[n].dtype) for n in both if a.columns[n].dtype != b.columns[n].dtype},
        {n: (a.columns[n].null_ratio, b.columns[n].null_ratio) for n in both if a.columns[n].null_ratio != b.columns[n].null_ratio},
        a.row_count,
        b.row_count,
    )


@dataclass(frozen=True)
class QualityGateIssue:
    gate: str
    message: str
    column: str | None = None
    baseline: Any = None
    current: Any = None
    threshold: Any = None

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class QualityGateResult:
    issues: list[QualityGateIssue] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.issues

    def summary(self) -> dict:
        by: dict[str, int] = {}
        for i in self.issues:
            by[i.gate] = by.get(i.gate, 0) + 1
        return {"passed": self.passed, "issue_count": len(self.issues), "issues_by_gate": by}

    def to_dict(self) -> dict:
        return self.summary() | {"issues": [i.to_dict() for i in self.issues]}

    def to_json(self, *, indent=None, output=None) -> str:
        return _emit(json.dumps(self.to_dict(), indent=indent, default=str), output)

    def to_markdown(self, output=None) -> str:
        lines = [f"# Quality gates: {'passed' if self.passed else 'failed'}", ""]
        if self.issues:
            lines += ["| gate | column | message |", "|---|---|---|", *[f"| {i.gate} | {_cell(i.column or '-')} | {_cell(i.message)} |" for i in self.issues]]
        return _emit("\n".join(lines) + "\n", output)

    def raise_for_failures(self) -> None:
        if self.issues:
            from tidewater.errors import SchemaValidationError

            raise SchemaValidationError("; ".join(i.message for i in self.issues), self)


def _relative(a: float, b: float) -> float:
    return abs(b - a) / abs(a) if a else (0.0 if b == a else float("inf"))


def check_quality_gates(
    baseline_profile,
    current_profile,
    *,
    max_row_count_delta_ratio: float | None = 0.1,
    max_duplicate_ratio_delta: float | None = 0.05,
    max_null_ratio_delta: float | None = 0.05,
    max_numeric_mean_delta_ratio: float | None = 0.1,
    max_numeric_std_delta_ratio: float | None = 0.2,
    allow_new_columns: bool = False,
    allow_missing_columns: bool = False,
    fail_on_dtype_change: bool = True,
) -> QualityGateResult:
    """Whether the current profile stays near the baseline; a threshold of None switches its gate off.

    A frame in a profile's place costs one aggregate, and one distinct for the gate on duplicates.
    """
    limits = (max_row_count_delta_ratio, max_duplicate_ratio_delta, max_null_ratio_delta, max_numeric_mean_delta_ratio, max_numeric_std_delta_ratio)
    if any(x is not None and x < 0 for x in limits):
        raise ValueError("check_quality_gates: thresholds must not be negative")
    a, b = (_outline(x, max_duplicate_ratio_delta is not None) for x in (baseline_profile, current_profile))
    out: list[QualityGateIssue] = []

    def gate(name: str, column: str | None, x, y, delta: float, most: float | None) -> None:
        if most is not None and delta > most:
            out.append(QualityGateIssue(name, f"{name} of {column or 'the frame'} went from {x} to {y}, by {delta:.4g}; at most {most} is allowed", column, x, y, most))

    gate("row_count", None, a.row_count, b.row_count, _relative(a.row_count, b.row_count), max_row_count_delta_ratio)
    if max_duplicate_ratio_delta is not None:
        gate("duplicate_ratio", None, a.duplicate_ratio, b.duplicate_ratio, b.duplicate_ratio - a.duplicate_ratio, max_duplicate_ratio_delta)
    if not allow_missing_columns:
        out += [QualityGateIssue("missing_column", f"column {n} is missing", n) for n in a.columns if n not in b.columns]
    if not allow_new_columns:
        out += [QualityGateIssue("new_column", f"column {n} is new", n) for n in b.columns if n not in a.columns]
    for n, x in a.columns.items():
        y: ColumnProfile | ColumnOutline | None = b.columns.get(n)
        if y is None:
            continue
        if x.dtype != y.dtype:
            if fail_on_dtype_change:
                out.append(QualityGateIssue("dtype", f"column {n} went from {x.dtype} to {y.dtype}", n, x.dtype, y.dtype))
            continue
        gate("null_ratio", n, x.null_ratio, y.null_ratio, y.null_ratio - x.null_ratio, max_null_ratio_delta)
        if x.dtype in ("int64", "float64"):
            for m, most in (("mean", max_numeric_mean_delta_ratio), ("std", max_numeric_std_delta_ratio)):
                p, q = getattr(x, m), getattr(y, m)
                if p is not None and q is not None:
                    gate(f"numeric_{m}", n, p, q, _relative(p, q), most)
    return QualityGateResult(out)


@dataclass(frozen=True)
class ColumnDiff:
    column: str
    change: str
    expected: Any = None
    observed: Any = None

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class DataFrameDiffReport:
    expected_rows: int
    observed_rows: int
    added: list[ColumnDiff] = field(default_factory=list)
    removed: list[ColumnDiff] = field(default_factory=list)
    dtype_changed: list[ColumnDiff] = field(default_factory=list)
    null_ratio_changed: list[ColumnDiff] = field(default_factory=list)

    @property
    def row_count_delta(self) -> int:
        return self.observed_rows - self.expected_rows

    @property
    def has_breaking_changes(self) -> bool:
        return bool(self.removed or self.dtype_changed)

    @property
    def is_clean(self) -> bool:
        return not (self.added or self.removed or self.dtype_changed or self.null_ratio_changed or self.row_count_delta)

    def summary(self) -> dict:
        return {k: len(getattr(self, k)) for k in ("added", "removed", "dtype_changed", "null_ratio_changed")} | {"row_count_delta": self.row_count_delta, "has_breaking_changes": self.has_breaking_changes, "is_clean": self.is_clean}

    def to_dict(self) -> dict:
        return asdict(self) | self.summary() | {k: [d.to_dict() for d in getattr(self, k)] for k in ("added", "removed", "dtype_changed", "null_ratio_changed")}

    def to_markdown(self) -> str:
        lines = ["# Differences", "", f"rows: {self.expected_rows} expected, {self.observed_rows} observed", "", "| column | change | expected | observed |", "|---|---|---|---|"]
        lines += [f"| {_cell(d.column)} | {d.change} | {d.expected} | {d.observed} |" for k in ("added", "removed", "dtype_changed", "null_ratio_changed") for d in getattr(self, k)]
        return "\n".join(lines) + "\n"


def null_ratios(df: DataFrame) -> tuple[int, dict[str, float]]:
    """Rows, and each column's share of nulls, blank text being null; one aggregate."""
    kinds = dtypes(df)
    gone = {c: (quoted(c).isNull() | (text.strip_unicode(quoted(c)) == "") if k == "string" else quoted(c).isNull() | F.isnan(quoted(c)) if k == "float64" else quoted(c).isNull()) for c, k in kinds.items()}
    found = df.agg(F.count(F.lit(1)), *[F.count_if(x) for x in gone.values()]).first()
    return found[0], {c: round(n / found[0], 6) if found[0] else 0.0 for c, n in zip(gone, found[1:], strict=True)}


def diff_dataframes(expected: DataFrame, observed: DataFrame, *, null_ratio_threshold: float = 0.0) -> DataFrameDiffReport:
    """Columns added, removed, of another type, or with another share of nulls; a changed type hides the nulls."""
    if not 0 <= null_ratio_threshold <= 1:
        raise ValueError("diff_dataframes: null_ratio_threshold must be within 0 and 1")
    a, b = dtypes(expected), dtypes(observed)
    (n, x), (m, y) = null_ratios(expected), null_ratios(observed)
    out = DataFrameDiffReport(n, m)
    out.added = [ColumnDiff(c, "added", None, b[c]) for c in b if c not in a]
    out.removed = [ColumnDiff(c, "removed", a[c], None) for c in a if c not in b]
    for c in a:
        if c in b and a[c] != b[c]:
            out.dtype_changed.append(ColumnDiff(c, "dtype_changed", a[c], b[c]))
        elif c in b and abs(x[c] - y[c]) > null_ratio_threshold:
            out.null_ratio_changed.append(ColumnDiff(c, "null_ratio_changed", x[c], y[c]))
    return out
