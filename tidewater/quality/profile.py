"""Profiles: what the columns of a frame hold, from a few passes.

One wide aggregate gives every statistic of every column, one beside it the
distinct values, and a few passes of counting the quantiles; another gives the
histograms, whose edges need these; top values are one grouped pass over
(column, value) pairs for all columns together; duplicates are one distinct.
"""

from __future__ import annotations

import html
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.functions.types import dtypes, names, quoted
from tidewater.operators.frame import memory_usage
from tidewater.operators.quantiles import quantiles
from tidewater.operators.rowid import ROW, with_row_id

EMAIL, URL, PHONE = r"^(?:[^@\s]+@[^@\s]+\.[^@\s]+)$", r"^(?:https?://\S+)$", r"^(?:\+?[0-9][0-9 .()\-]{6,}[0-9])$"
INTEGER, BOOLEAN = r"^[+-]?[0-9]+$", ("true", "false", "1", "0")
DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
IDENTIFIERS = {"id", "uuid", "zip", "zipcode", "zip_code"}
BINS, TOP = 10, 5
REDACTED = "[redacted]"


@dataclass
class ColumnProfile:
    """Statistics of a column. For text, min, max and mean are lengths."""

    name: str
    dtype: str
    semantic_type: str
    row_count: int
    null_count: int
    null_ratio: float
    unique_count: int
    unique_ratio: float
    empty_string_count: int = 0
    whitespace_count: int = 0
    suggested_dtype: str | None = None
    email_validity_ratio: float | None = None
    url_validity_ratio: float | None = None
    min: Any = None
    max: Any = None
    mean: float | None = None
    std: float | None = None
    q25: float | None = None
    q50: float | None = None
    q75: float | None = None
    q95: float | None = None
    iqr: float | None = None
    outlier_lower_bound: float | None = None
    outlier_upper_bound: float | None = None
    outlier_count: int | None = None
    outlier_ratio: float | None = None
    sample_values: list[Any] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    top_values: list[tuple[Any, int, float]] | None = None
    top_values_is_approximate: bool = False
    top_values_sample_count: int | None = None
    top_values_sample_ratio: float | None = None
    histogram: list[tuple[float, float, int, float]] | None = None

    def to_dict(self, *, redact_sample_values: bool = False) -> dict:
        out = asdict(self)
        if redact_sample_values:
            out["sample_values"] = [REDACTED] * len(self.sample_values)
            out["top_values"] = None if self.top_values is None else [(REDACTED, n, r) for _, n, r in self.top_values]
        return out


class CleaningSuggestion(tuple):
    """A step of a pipeline, (name, options), that also tells how sure and why."""

    def __new__(cls, step: str, kwargs: dict, confidence_score: float = 1.0, confidence_reason: str = ""):
        out = super().__new__(cls, (step, kwargs))
        out.confidence_score, out.confidence_reason = confidence_score, confidence_reason
        return out

    @property
    def step(self) -> str:
        return self[0]

    @property
    def kwargs(self) -> dict:
        return self[1]

    def to_dict(self) -> dict:
        return {"step": self.step, "kwargs": self.kwargs, "confidence_score": self.confidence_score, "confidence_reason": self.confidence_reason}


@dataclass
class DataQualityReport:
    """The profile of a frame."""

    row_count: int
    column_count: int
    memory_usage: int
    duplicate_rows: int
    duplicate_ratio: float
    columns: dict[str, ColumnProfile]
    quality_score: float = 100.0
    score_components: dict[str, float] = field(default_factory=dict)
    suggestions: list[CleaningSuggestion] = field(default_factory=list)
    missingness_correlations: list[dict[str, Any]] = field(default_factory=list)

    @property
    def score_breakdown(self) -> dict[str, float]:
        return dict(self.score_components)

    def _kept(self, exclude) -> dict[str, ColumnProfile]:
        return {n: c for n, c in self.columns.items() if n not in set(exclude or ())}

    def to_dict(self, *, redact_sample_values: bool = False, exclude_columns=None) -> dict:
        kept = self._kept(exclude_columns)
        out = {k: getattr(self, k) for k in ("row_count", "column_count", "memory_usage", "duplicate_rows", "duplicate_ratio", "quality_score", "score_components")}
        out["columns"] = {n: c.to_dict(redact_sample_values=redact_sample_values) for n, c in kept.items()}
        out["suggestions"] = [s.to_dict() for s in self.suggestions]
        out["missingness_correlations"] = [m for m in self.missingness_correlations if m["left"] in kept and m["right"] in kept]
        return out

    def to_json(self, *, indent: int | None = None, redact_sample_values: bool = False, exclude_columns=None, output=None) -> str:
        return _emit(json.dumps(self.to_dict(redact_sample_values=redact_sample_values, exclude_columns=exclude_columns), indent=indent, default=str, ensure_ascii=False), output)

    def summary(self) -> dict:
        return {
            "rows": self.row_count,
            "columns": self.column_count,
            "quality_score": self.quality_score,
            "duplicate_rows": self.duplicate_rows,
            "duplicate_ratio": self.duplicate_ratio,
            "columns_with_nulls": [n for n, c in self.columns.items() if c.null_count],
            "columns_with_warnings": {n: c.warnings for n, c in self.columns.items() if c.warnings},
            "suggestion_count": len(self.suggestions),
        }

    def to_pandas(self):
        import pandas as pd

        return pd.DataFrame([c.to_dict() for c in self.columns.values()])

    def to_markdown(self, output=None) -> str:
        lines = ["# Data quality", "", f"* rows: {self.row_count}", f"* columns: {self.column_count}", f"* duplicate rows: {self.duplicate_rows} ({self.duplicate_ratio:.2%})", f"* score: {self.quality_score:.2f}", ""]
        lines += ["| column | type | kind | nulls | unique | warnings |", "|---|---|---|---|---|---|"]
        lines += [f"| {_cell(c.name)} | {c.dtype} | {c.semantic_type} | {c.null_ratio:.2%} | {c.unique_count} | {', '.join(c.warnings) or '-'} |" for c in self.columns.values()]
        if self.suggestions:
            lines += ["", "## Suggestions", "", *[f"* `{s.step}` {s.kwargs} ({s.confidence_score:.2f}: {s.confidence_reason})" for s in self.suggestions]]
        return _emit("\n".join(lines) + "\n", output)

    def to_html(self, file_path=None, output=None) -> str:
        """A page of its own, all values escaped."""
        e = lambda x: html.escape(str(x))
        rows = "".join(f"<tr><td>{e(c.name)}</td><td>{e(c.dtype)}</td><td>{e(c.semantic_type)}</td><td>{c.null_ratio:.2%}</td><td>{c.unique_count}</td><td>{e(', '.join(map(str, c.sample_values)))}</td><td>{e(', '.join(c.warnings))}</td></tr>" for c in self.columns.values())
        tips = "".join(f"<li><code>{e(s.step)}</code> {e(s.kwargs)}: {e(s.confidence_reason)}</li>" for s in self.suggestions)
        page = (
            "<!doctype html><html><head><meta charset='utf-8'><title>Data quality</title><style>body{font-family:sans-serif}td,th{padding:4px 8px;border-bottom:1px solid #ccc;text-align:left}</style></head><body>"
            f"<h1>Data quality</h1><p>{self.row_count} rows, {self.column_count} columns, {self.duplicate_rows} duplicates, score {self.quality_score:.2f}</p>"
            f"<table><tr><th>column</th><th>type</th><th>kind</th><th>nulls</th><th>unique</th><th>samples</th><th>warnings</th></tr>{rows}</table><h2>Suggestions</h2><ul>{tips}</ul></body></html>"
        )
        return _emit(page, file_path or output)


def _cell(x) -> str:
    return str(x).replace("|", "\\|").replace("\n", " ")


def _emit(body: str, output) -> str:
    if output is not None:
        if hasattr(output, "write"):
            output.write(body)
        else:
            from tidewater.plans.pipeline import write_whole

            write_whole(Path(output), body)
    return body


def _ratio(n, of) -> float:
    return round(n / of, 6) if of else 0.0


def _values(kinds: dict[str, str], columns: list[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Each column with NaN as null, and the finite values of each numeric one."""
    value = {c: F.when(~F.isnan(quoted(c)), quoted(c)) if kinds[c] == "float64" else quoted(c) for c in columns}
    return value, {c: F.when(F.abs(value[c].cast("double")) < float("inf"), value[c].cast("double")) for c in columns if kinds[c] in ("int64", "float64")}


@dataclass
class ColumnOutline:
    """As in the column's profile."""

    dtype: str
    null_ratio: float
    mean: float | None
    std: float | None


@dataclass
class Outline:
    """What drift and gates compare of a profile."""

    row_count: int
    columns: dict[str, ColumnOutline]
    duplicate_ratio: float | None = None


def outline(df: DataFrame, duplicates: bool = False) -> Outline:
    """The frame's outline, each figure as ``profile`` gives it: one aggregate, and one distinct for the share of ``duplicates``."""
    kinds = dtypes(df)
    value, finite = _values(kinds, df.columns)
    parts = [F.struct(F.count_if(v.isNull()).alias("nulls"), *[f(finite[c]).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp)) if c in finite]).alias(f"s{i}") for i, (c, v) in enumerate(value.items())]
    rows, *found = df.agg(F.count(F.lit(1)), *parts).first()
    out = Outline(rows, {c: ColumnOutline(kinds[c], _ratio(s["nulls"], rows), *((s["mean"], s["std"]) if c in finite else (None, None))) for c, s in zip(value, found, strict=True)})
    if duplicates:
        out.duplicate_ratio = _ratio(rows - df.distinct().count(), rows) if df.columns else 0.0
    return out


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with all its statistics.

    Quantiles are found first, by a few passes of counting. Distinct values have
    an aggregate of their own: in the other one, each distinct value would carry
    the state of all the rest through the shuffle.
    """
    kinds = dtypes(df)
    value, finite = _values(kinds, columns)
    found = dict(zip(finite, quantiles(df, list(finite.values()), QUANTILES), strict=True))
    aggregates, parts = [], []
    for i, c in enumerate(columns):
        v, kind = value[c], kinds[c]
        one: dict[str, Any] = {"row_count": F.count(F.lit(1)), "null_count": F.count_if(v.isNull())}
        if kind in ("int64", "float64"):
            x = finite[c]
            one |= {"finite": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x)}
        elif kind == "string":
            bare, n = text.strip_unicode(v), F.length(v).cast("double")
            one |= {"min": F.min(n), "max": F.max(n), "mean": F.avg(n), "whitespace_count": F.count_if(v != bare), "empty_string_count": F.count_if(bare == "")}
            one |= {k: F.count_if(bare.rlike(r)) for k, r in (("emails", EMAIL), ("urls", URL), ("phones", PHONE), ("dates", DATE), ("ints", INTEGER))}
            number = F.abs(bare.try_cast("double")) < float("inf")
            # the cast comes second: of a text that is no number, it costs an exception
            one |= {"bools": F.count_if(F.lower(bare).isin(*BOOLEAN)), "floats": F.count_if(bare.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$") & number)}
        aggregates.append(F.struct(*[x.alias(n) for n, x in one.items()]).alias(f"s{i}"))
        known = {n: F.col(f"s{i}.{n}") for n in one} | {"unique_count": F.col(f"u{i}")} | dict(zip(("q25", "q50", "q75", "q95"), map(F.lit, found.get(c) or ()), strict=False))
        parts.append(F.struct(F.lit(c).alias("name"), F.lit(kind).alias("dtype"), *[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in _STATS]))
    distinct = df.agg(*[F.count_distinct(value[c]).alias(f"u{i}") for i, c in enumerate(columns)])
    return df.agg(*aggregates).crossJoin(distinct).select(F.explode(F.array(*parts)).alias("s")).select("s.*")


QUANTILES = [0.25, 0.5, 0.75, 0.95]
_STATS = [(n, "long") for n in ("row_count", "null_count", "unique_count", "finite", "whitespace_count", "empty_string_count", "emails", "urls", "phones", "dates", "ints", "bools", "floats")] + [(n, "double") for n in ("min", "max", "mean", "std", "q25", "q50", "q75", "q95")]


def histograms(df: DataFrame, ranges: dict[str, tuple[float, float]], fences: dict[str, tuple[float, float]] | None = None) -> dict[str, tuple[list[int], int]]:
    """Counts in ``BINS`` equal bins, the last one closed, and outliers beyond the fences; one aggregate for all columns."""
    cells, exprs = [], []
    for i, (c, (lo, hi)) in enumerate(ranges.items()):
        x = F.when(F.abs(quoted(c).cast("double")) < float("inf"), quoted(c).cast("double"))
        step = (hi - lo) / BINS
        f = (fences or {}).get(c)
        # a column of their own, so that they are found once a row
        cells.append(F.when(x.isNotNull(), F.least(F.lit(BINS - 1), F.floor((x - lo) / step).cast("int"))).alias(f"at{i}"))  # ``least`` skips nulls
        cells.append((((x < f[0]) | (x > f[1])) if f else F.lit(False)).alias(f"out{i}"))
        exprs += [F.count_if(F.col(f"at{i}") == k) for k in range(BINS)] + [F.count_if(F.col(f"out{i}"))]
    if not exprs:
        return {}
    found = df.select(*cells).agg(*[x.alias(f"h{i}") for i, x in enumerate(exprs)]).first()
    return {c: (list(found[k * (BINS + 1) : k * (BINS + 1) + BINS]), found[k * (BINS + 1) + BINS]) for k, c in enumerate(ranges)}


def value_counts(df: DataFrame, columns: list[str], top: int = TOP) -> DataFrame:
    """(name, value, n): the most frequent values of each column, as text; ties go to the lesser value.

    All columns are counted by one exchange keyed on (column, value).
    """
    kinds = dtypes(df)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.when(~F.isnan(quoted(c)), quoted(c)).cast("string").alias("value") if kinds[c] == "float64" else quoted(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("x")).select("x.*").where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    # a short list by partition first, so that the window sees few rows
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)


def missingness_correlations(df: DataFrame, columns=None, threshold: float = 0.5) -> list[dict]:
    """Pearson's correlation of null marks for pairs of columns, of at least ``threshold`` in size, strongest first.

    Columns without nulls, or of nothing else, have none. Two aggregates.
    """
    chosen = names(df, columns, "missingness_correlations") if df.columns else []
    if not chosen:
        return []
    kinds = dtypes(df)
    null = {c: (quoted(c).isNull() | F.isnan(quoted(c)) if kinds[c] == "float64" else quoted(c).isNull()) for c in chosen}
    found = df.agg(F.count(F.lit(1)), *[F.count_if(null[c]) for c in chosen]).first()
    some = [c for c, k in zip(chosen, found[1:], strict=True) if 0 < k < found[0]]
    pairs = [(a, b) for i, a in enumerate(some) for b in some[i + 1 :]]
    if not pairs:
        return []
    r = df.agg(*[F.corr(null[a].cast("double"), null[b].cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    out = [{"left": a, "right": b, "correlation": round(x, 6)} for (a, b), x in zip(pairs, r, strict=True) if x is not None and abs(x) >= threshold]
    return sorted(out, key=lambda x: (-abs(x["correlation"]), x["left"], x["right"]))


def duplicate_rows(df: DataFrame) -> int:
    """Rows less distinct rows; nulls agree."""
    return df.count() - df.distinct().count()


def semantic_type(name: str, s: dict, kind: str) -> str:
    n = s["row_count"] - s["null_count"]
    low = name.lower()
    if not n:
        return "empty"
    if low in IDENTIFIERS or low.endswith("_id"):
        return "identifier"
    if kind in ("int64", "float64"):
        return "numeric"
    if kind == "bool":
        return "boolean"
    for key, label in (("emails", "email"), ("urls", "url"), ("phones", "phone"), ("dates", "datetime")):
        if s[key] is not None and s[key] / n >= 0.8:
            return label
    return "categorical" if s["unique_count"] <= max(20, n * 0.2) else "text"


def suggested_dtype(s: dict, kind: str) -> str | None:
    n = s["row_count"] - s["null_count"]
    if kind != "string" or not n:
        return None
    return "bool" if s["bools"] == n else "int64" if s["ints"] == n else "float64" if s["floats"] == n else None


def profile(
    df: DataFrame,
    *,
    exclude_columns=None,
    sample_size: int = 5,
    approx_top_values: bool = False,
    approx_top_values_min_unique: int = 1000,
    approx_top_values_min_ratio: float = 0.2,
    approx_top_values_sample_size: int = 2000,
    semantic_scoring: bool = False,
) -> DataQualityReport:
    """The frame's profile. NaN counts as null; infinities are left out of numeric statistics."""
    if sample_size < 0:
        raise ValueError("profile: sample_size must not be negative")
    gone = set(exclude_columns or ())
    if gone - set(df.columns):
        raise ValueError(f"profile: no column {', '.join(sorted(gone - set(df.columns)))}")
    columns = [c for c in df.columns if c not in gone]
    df = df.select(*map(quoted, columns))
    if not columns:
        return DataQualityReport(df.count(), 0, 0, 0, 0.0, {})
    stats = {r["name"]: r.asDict() for r in column_stats(df, columns).collect()}
    rows = next(iter(stats.values()))["row_count"]
    ranges, fences = {}, {}
    for c, s in stats.items():
        if s["finite"]:
            ranges[c] = (s["min"], s["max"]) if s["min"] < s["max"] else (s["min"] - 0.5, s["max"] + 0.5)
            if s["finite"] >= 4:
                iqr = s["q75"] - s["q25"]
                fences[c] = (round(s["q25"] - 1.5 * iqr, 4), round(s["q75"] + 1.5 * iqr, 4))
    bins = histograms(df, ranges, fences)
    approximate = [c for c, s in stats.items() if approx_top_values and s["dtype"] == "string" and s["unique_count"] >= approx_top_values_min_unique and _ratio(s["unique_count"], rows - s["null_count"]) >= approx_top_values_min_ratio]
    exact = [c for c in columns if c not in approximate]
    tops: dict[str, list] = {c: [] for c in columns}
    sampled = 0
    if exact:
        for r in value_counts(df, exact).orderBy("name", "rank").collect():
            tops[r["name"]].append((r["value"], r["n"]))
    if approximate:
        sample = with_row_id(df.select(*map(quoted, approximate))).orderBy(F.xxhash64(ROW), ROW).limit(approx_top_values_sample_size).drop(ROW).persist()
        sampled = sample.count()
        for r in value_counts(sample, approximate).orderBy("name", "rank").collect():
            tops[r["name"]].append((r["value"], r["n"]))
        sample.unpersist()
    samples = _samples(df, columns, sample_size, stats)
    duplicates = rows - df.distinct().count()
    out = {}
    for c, s in stats.items():
        n, kind = rows - s["null_count"], s["dtype"]
        p = ColumnProfile(c, kind, semantic_type(c, s, kind), rows, s["null_count"], _ratio(s["null_count"], rows), s["unique_count"], _ratio(s["unique_count"], n), s["empty_string_count"] or 0, s["whitespace_count"] or 0, suggested_dtype(s, kind))
        p.min, p.max, p.mean, p.std, p.q25, p.q50, p.q75, p.q95 = (s[k] for k in ("min", "max", "mean", "std", "q25", "q50", "q75", "q95"))
        if kind == "int64" and p.min is not None:
            p.min, p.max = int(p.min), int(p.max)
        if kind == "string" and p.min is not None:
            p.min, p.max = int(p.min), int(p.max)
            if p.semantic_type == "email":
                p.email_validity_ratio = _ratio(s["emails"], n)
            if p.semantic_type == "url":
                p.url_validity_ratio = _ratio(s["urls"], n)
        if c in fences:
            p.iqr = p.q75 - p.q25
            p.outlier_lower_bound, p.outlier_upper_bound = fences[c]
            p.outlier_count = bins[c][1]
            p.outlier_ratio = _ratio(p.outlier_count, s["finite"])
        if c in bins:
            lo, hi = ranges[c]
            step = (hi - lo) / BINS
            p.histogram = [(lo + k * step, hi if k == BINS - 1 else lo + (k + 1) * step, m, _ratio(m, s["finite"])) for k, m in enumerate(bins[c][0])]
        base = sampled if c in approximate else n
        p.top_values = [(_typed(v, kind), m, _ratio(m, base)) for v, m in tops[c]]
        if c in approximate:
            p.top_values_is_approximate, p.top_values_sample_count, p.top_values_sample_ratio = True, sampled, _ratio(sampled, n)
        p.sample_values = samples[c]
        p.warnings = column_warnings(p)
        out[c] = p
    report = DataQualityReport(rows, len(columns), memory_usage(df), duplicates, _ratio(duplicates, rows), out)
    from tidewater.quality.score import quality_score, suggest_cleaning

    report.quality_score, report.score_components = quality_score(report, semantic_scoring)
    report.missingness_correlations = missingness_correlations(df)
    report.suggestions = suggest_cleaning(report)
    return report


def _typed(value: str, kind: str):
    return {"int64": int, "float64": float, "bool": lambda v: v == "true"}.get(kind, str)(value)


def _samples(df: DataFrame, columns: list[str], size: int, stats: dict) -> dict[str, list]:
    """The first values of each column that aren't null, in the frame's order."""
    out: dict[str, list] = {c: [] for c in columns}
    if not size:
        return out
    for r in df.limit(max(size * 4, 20)).collect():
        for c in columns:
            v = r[c]
            if v is not None and v == v and len(out[c]) < size:
                out[c].append(v)
    for c in columns:
        if len(out[c]) < min(size, stats[c]["row_count"] - stats[c]["null_count"]):
            v = quoted(c)
            keep = v.isNotNull() & ~F.isnan(v) if stats[c]["dtype"] == "float64" else v.isNotNull()
            out[c] = [r[0] for r in df.select(v).where(keep).limit(size).collect()]
    return out


def column_warnings(p: ColumnProfile) -> list[str]:
    n = p.row_count - p.null_count
    out = []
    if p.null_count:
        out.append("contains_nulls")
    if p.row_count and not n:
        out.append("all_null")
    if n and p.unique_count == 1:
        out.append("constant")
    elif p.top_values and p.top_values[0][2] >= 0.95:
        out.append("near_constant")
    if p.unique_count >= 100 and p.unique_ratio >= 0.9 and p.semantic_type in ("identifier", "text"):
        out.append("high_cardinality")
    if p.whitespace_count:
        out.append("leading_or_trailing_whitespace")
    if p.empty_string_count:
        out.append("empty_strings")
    if p.outlier_count:
        out.append("potential_outliers")
    return out
