"""Scores, suggestions and automatic cleaning."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tidewater.operators.rows import drop_duplicates
from tidewater.operators.values import cast_types, strip_whitespace
from tidewater.quality.profile import CleaningSuggestion, DataQualityReport, profile


def quality_score(report: DataQualityReport, semantic_scoring: bool = False) -> tuple[float, dict[str, float]]:
    """100 less penalties for duplicates, nulls, mismatched types and, if asked for, invalid e-mail addresses and URLs."""
    cols = list(report.columns.values())
    n = max(len(cols), 1)
    parts = {
        "duplicate_penalty": min(20.0, report.duplicate_ratio * 100),
        "null_penalty": min(40.0, sum(c.null_ratio for c in cols) / n * 100),
        "dtype_mismatch_penalty": min(40.0, sum(c.suggested_dtype is not None and c.suggested_dtype != c.dtype for c in cols) / n * 100),
    }
    if semantic_scoring:
        for key, ratios in (("email_penalty", [c.email_validity_ratio for c in cols]), ("url_penalty", [c.url_validity_ratio for c in cols])):
            bad = [1 - r for r in ratios if r is not None]
            parts[key] = min(10.0, sum(bad) / len(bad) * 100) if bad else 0.0
        over = parts["email_penalty"] + parts["url_penalty"] - 15
        if over > 0:
            parts["url_penalty"] -= over
    parts = {k: round(v, 2) for k, v in parts.items()}
    return round(max(0.0, 100 - sum(parts.values())), 2), parts


def suggest_cleaning(frame_or_report) -> list[CleaningSuggestion]:
    """Steps that the profile calls for; the list is a valid pipeline."""
    report = frame_or_report if isinstance(frame_or_report, DataQualityReport) else profile(frame_or_report)
    out = []
    padded = [n for n, c in report.columns.items() if c.whitespace_count]
    if padded:
        out.append(CleaningSuggestion("strip_whitespace", {"subset": padded}, 0.95, "text with white space at its ends"))
    casts, low = {}, 0.95
    for n, c in report.columns.items():
        to = c.suggested_dtype
        if not to or (c.semantic_type == "identifier" and to in ("int64", "float64")):
            continue
        casts[n] = to
        support = c.row_count - c.null_count
        low = min(low, 0.95 - (0.3 if support < 5 else 0.15 if support < 20 else 0.0))
    if casts:
        out.append(CleaningSuggestion("cast_types", {"mapping": casts}, round(low, 2), "all values read as another type"))
    if report.duplicate_rows:
        many = report.duplicate_ratio > 0.5
        out.append(CleaningSuggestion("drop_duplicates", {"keep": "first"}, 0.75 if many else 0.95, "more than half of the rows repeat" if many else "rows repeat"))
    return out


@dataclass
class CleanStepRecord:
    step: str
    kwargs: dict[str, Any]
    rows_before: int
    rows_after: int
    reason: str = ""

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class CleanExplanation:
    mode: str
    steps: list[CleanStepRecord] = field(default_factory=list)
    skipped: list[dict[str, Any]] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


def auto_clean(df: DataFrame, *, mode: str = "safe", return_report: bool = False, dry_run: bool = False, allow_lossy_casts: bool = False, confirmed_casts: dict | None = None, explain: bool = False):
    """Suggested steps, applied: only stripping in ``safe`` mode, all in ``strict``.

    Casts need ``allow_lossy_casts`` and ``confirmed_casts`` equal to what is
    suggested. After strict steps, rows that have become equal go too.
    ``dry_run`` returns the steps instead of a frame. ``explain`` counts rows
    around each step and adds a CleanExplanation; ``return_report`` adds the
    profile.
    """
    if mode not in ("safe", "strict"):
        raise ValueError("auto_clean: mode must be safe or strict")
    report = profile(df)
    chosen, why = [], CleanExplanation(mode)
    for s in report.suggestions:
        if s.step == "strip_whitespace" or (mode == "strict" and s.step == "drop_duplicates"):
            chosen.append(s)
        elif mode == "strict" and s.step == "cast_types":
            if not allow_lossy_casts:
                why.skipped.append({"step": s.step, "kwargs": s.kwargs, "reason": "casts need allow_lossy_casts"})
            elif dict(confirmed_casts or {}) != s.kwargs["mapping"]:
                raise ValueError(f"auto_clean: confirmed_casts must be {s.kwargs['mapping']}")
            else:
                chosen.append(s)
        else:
            why.skipped.append({"step": s.step, "kwargs": s.kwargs, "reason": f"not in {mode} mode"})
    if dry_run:
        result = chosen
    else:
        result, before = df, report.row_count
        for s in chosen:
            step = {"strip_whitespace": strip_whitespace, "cast_types": cast_types, "drop_duplicates": drop_duplicates}[s.step]
            options = dict(s.kwargs)
            result = step(result, **options)
            if explain:
                after = result.count()
                why.steps.append(CleanStepRecord(s.step, options, before, after, s.confidence_reason))
                before = after
        if mode == "strict" and not any(s.step == "drop_duplicates" for s in chosen):
            result = drop_duplicates(result)
            if explain:
                after = result.count()
                if after < before:
                    why.steps.append(CleanStepRecord("drop_duplicates", {"keep": "first"}, before, after, "rows became equal"))
    extra = ([report] if return_report else []) + ([why] if explain else [])
    return (result, *extra) if extra else result
